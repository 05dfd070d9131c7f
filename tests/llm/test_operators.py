"""The corpus operators against plain Python versions, on rows with nulls, ties, repeats, clashing names and very long texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import bpe, chat, ledger, mixing, pii, quality_model, secrets, setjoin, sharding, syncmers
from tests.llm import brute


def by_row(df, *columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def want(rows):
    return sorted(map(repr, rows))


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark)


def empty(docs):
    return docs.limit(0)


def test_secrets(docs):
    got = secrets.digest(secrets.scan(docs))
    expected = []
    for r in brute.ROWS:
        spans, n = brute.secrets(r[1])
        expected.append((r[0], *n, brute.digest(spans)))
    assert by_row(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want(expected)
    assert secrets.digest(secrets.scan(empty(docs))).count() == 0


def test_secret_ownership(spark):
    rows = [(i, f"token = {'abcdef0123456789' if i < 6 else f'x9y8z7w6v5u4{i}q'}", "en", f"src{i % 3}", 1) for i in range(8)]
    got = {r["doc_id"]: r["spans"][0]["verdict"] for r in secrets.scan(brute.documents(spark, rows)).collect()}
    assert [got[i] for i in range(8)] == ["example"] * 6 + ["live"] * 2


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{i:020x}" for i in range(3000))
    r = secrets.digest(secrets.scan(brute.documents(spark, [(1, text, "en", "s", 1)]))).first()
    assert r["n_hex"] == 3000 and r["base_sha256"] == brute.digest(brute.secrets(text)[0])


def test_personal_data(docs):
    got = pii.digest(pii.find(docs))
    expected = []
    for r in brute.ROWS:
        spans, n = brute.personal(r[1])
        expected.append((r[0], *n, brute.digest(spans)))
    assert by_row(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want(expected)
    assert pii.find(empty(docs)).count() == 0


def test_personal_data_fuzz():
    random.seed(5)
    pieces = ["a@b.co", "a", "@", ".", "1.2.3.4", "255", "+1", " ", "-", "4111111111111111", "(", ")", "9", "x_y", "%", "\n", "é", "+44 20 7946 0958"]
    for _ in range(3000):
        t = "".join(random.choices(pieces, k=random.randint(0, 25)))
        got = [s for s in pii.spans(t) if s[0] in pii.BASE]
        assert ",".join(f"{k}:{a}:{b}" for k, a, b, _ in got) == brute.personal(t)[0], t


def test_redaction(docs):
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert text[0] is None and "4111 1111 1111 1111" not in text[11] and "[CARD]" in text[11] and "[IBAN]" in text[11]
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    assert pii.mask("abcdef", [("email", 1, 4, 1.0), ("ip", 2, 5, 1.0)]) == "a[EMAIL]f"


def test_rule_ledger(docs):
    led = ledger.apply_policy(ledger.ledger(docs))
    base = (F.col("failed").bitwiseAND(F.lit(ledger.mask(1)).cast("long")) != 0).alias("base_failed")
    got = led.select("*", base)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_row(got, *columns) == want((r[0], *brute.quality(r[1])) for r in brute.ROWS)
    assert not got.where("base_failed and kept").count()
    assert ledger.ledger(empty(docs)).count() == 0


def test_ablations(docs):
    led = ledger.ledger(docs).cache()
    rows = [r["failed"] & ledger.mask(2) for r in led.collect()]
    for r in ledger.ablations(led).collect():
        bit = 1 << ledger.NAMES.index(r["rule"])
        assert (r["n_failed"], r["n_only"], r["kept_without"]) == (sum(bool(x & bit) for x in rows), rows.count(bit), sum(not x & ~bit for x in rows))


def test_bpe_is_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    expected = []
    for r in brute.ROWS:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids
        text = own.decode(ids, skip_special_tokens=False)
        expected.append((r[0], len(ids), __import__("hashlib").sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.digest(text)))
    assert by_row(bpe.round_trip(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(expected)
    back = bpe.decode(bpe.encode(docs, path), path)
    assert by_row(back, "doc_id", "decoded") == want((r[0], own.decode(own.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in brute.ROWS)
    assert bpe.round_trip(empty(docs), path).count() == 0


def test_bpe_fuzz():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    random.seed(1)
    letters = "aabcdeé ßİΣς'’sTLLreve19<|>endoftext\n\t\x1c 漢字́İ😀.-_"
    texts = ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, "banana" * 50, "<|endoftext|>x<|startoftext|> <|endoftext|"]
    for t, a, b in zip(texts, codec.encode_batch(texts), own.encode_batch(texts, add_special_tokens=False), strict=True):
        assert a.tolist() == b.ids, t
    assert codec.pairs.naive(list("banan") + ["a</w>"]) == codec.pairs.encode_all(["banana"])["banana"]


@pytest.mark.parametrize("bound", [100, 0])
def test_mixing_targets(spark, docs, bound):
    rows = mixing.plan(docs, driver_sources=bound).collect()
    size = lambda t: len(brute.WORD.findall(t or ""))
    sums: dict = {}
    for r in brute.ROWS:
        sums[r[3]] = sums.get(r[3], 0) + size(r[1])
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        rest = sum(sums.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sums[s]}
        if not over:
            break
        target |= {s: 3 * sums[s] for s in over}
        free -= over
    target |= share
    assert len(rows) == len(brute.ROWS)
    by_size = {(sums[s], round(target[s], 6)) for s in names}
    for r in rows:
        assert (r["source_size"], round(r["target"], 6)) in by_size
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.plan(docs, driver_sources=bound).collect()))


def test_mixing_emits_copies(spark, data, docs):
    d = spark.read.parquet(f"{data}/documents.parquet")
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan(d).collect()}
    got = {r["doc_id"]: r["count"] for r in mixing.emit(d).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}
    assert mixing.emit(d).columns == d.columns and mixing.emit(docs).columns == docs.columns
    assert mixing.plan(empty(docs)).count() == 0 and mixing.emit(empty(docs)).count() == 0


def test_solve_caps():
    assert mixing.solve([10, 10, 100], [1, 2, 3], 3) == [20.0, 30.0, 70.0] or sum(mixing.solve([10, 10, 100], [1, 2, 3], 3)) == 120
    assert mixing.solve([0, 0], [1, 2], 3) == [0.0, 0.0] and mixing.solve([], [], 3) == []


def test_chat_round_trip(spark):
    random.seed(2)
    bits = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<", "|", "\\", "<\\|", "<\\\\|im", "é😀", " ", ">", ""]
    rows = [(c, t, random.choice(["user", "assistant", "system", None, "odd\nrole\\n", "<|im_end|>"]), random.choice([None, "".join(random.choices(bits, k=6))])) for c in range(40) for t in range(random.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (99, 0, "assistant", brute.LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[0], []).append((r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))
    expected = []
    for c, turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        expected.append((c, len(turns), brute.digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learnt), brute.digest(learnt)))
    made = chat.format_chats(df)
    assert by_row(chat.read_back(made), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == want(expected)
    for r in made.collect():
        assert r["formatted"].count(chat.START) == r["n_turns"] == r["formatted"].count("<|im_end|>")
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_chat_batches_cut_conversations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c}-{t}") for c in range(5) for t in range(50)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["conv_id"]: r["formatted"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for c in range(5):
        assert chat.parse(got[c]) == [("assistant" if t % 2 else "user", f"{c}-{t}") for t in range(50)]


def test_sharding(spark, docs, data, tmp_path):
    got = sharding.digest(sharding.shard(docs, str(tmp_path / "odd"))).collect()
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == want((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in brute.ROWS)
    whole = spark.read.parquet(f"{data}/documents.parquet")
    rows = sharding.digest(sharding.shard(whole, str(tmp_path / "map"))).collect()
    # A later run edits the stored map; with one more shard, rows move to it and the law holds again.
    again = sharding.digest(sharding.shard(whole, str(tmp_path / "map"), shards=41)).collect()
    assert {r["map_version"] for r in rows} == {2} and {r["map_version"] for r in again} == {3}
    for part, shards in ((rows, 40), (again, 41)):
        load = np.bincount([r["shard"] for r in part], [r["size"] for r in part], shards)
        largest = max(r["size"] for r in part)
        assert load.max() - load.min() <= largest and set(r["shard"] for r in part) <= set(range(shards))
    for part in (got, rows, again):
        for s in {r["shard"] for r in part}:
            assert sorted(r["slot"] for r in part if r["shard"] == s) == list(range(sum(r["shard"] == s for r in part)))
    assert sharding.shard(empty(docs), str(tmp_path / "empty")).count() == 0


def test_slot_map(spark, tmp_path):
    rng = np.random.default_rng(0)
    weight = rng.pareto(2, 8192) * 1000
    first = sharding.SlotMap.first()
    second = first.rebalance(weight)
    load = np.bincount(second.shard_of, weight, 40)
    assert load.max() / load.min() < 1.01 and second.version == 2
    replay = first.shard_of.copy()
    for version, slot, a, b in second.edits:
        assert version == 2 and replay[slot] == a
        replay[slot] = b
    assert (replay == second.shard_of).all() and (first.shard_of == np.arange(8192) % 40).all()
    for m in (first, second):
        m.save(spark, str(tmp_path / "map"))
    stored = sharding.SlotMap.load(spark, str(tmp_path / "map"))
    assert (stored.shard_of == second.shard_of).all() and (stored.version, stored.n_shards) == (2, 40)
    assert (sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).shard_of == first.shard_of).all()
    # A further shard is filled by moves into it alone.
    third = second.rebalance(weight, 41)
    moved = third.shard_of != second.shard_of
    assert np.bincount(third.shard_of, weight, 41)[40] > 0.9 * weight.sum() / 41 and moved.mean() < 0.2
    third.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).n_shards == 41


def near_rows():
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = random.choices(words, k=random.choice([3, 5, 9, 10, 12, 15, 16, 20, 30, 60, 150, 400]))
        for _ in range(random.randint(1, 8)):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                edit = random.randint(0, 3)
                if edit == 0:
                    w.append(random.choice(words))
                elif edit == 1 and len(w) > 1:
                    w.pop()
                elif edit == 2:
                    w[random.randrange(len(w))] = random.choice(words)
                else:
                    w.insert(random.randrange(len(w) + 1), random.choice(words))
            rows.append((n, " ".join(w).upper() if n % 7 == 0 else "  ".join(w), "en", "s", 1))
            n += 1
    passage = " ".join(random.choices(words, k=60))
    rows += [(n + i, f"{passage} " + " ".join(random.choices(words, k=random.randint(0, 60))), "en", "s", 1) for i in range(40)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("light", [None, 0, 18])
def test_near_duplicates(spark, docs, light, monkeypatch):
    if light is not None:
        monkeypatch.setattr(setjoin, "boundary", lambda percent=85, most=64: light)
    rows = near_rows() + (brute.ROWS if light is None else [])
    members, links = setjoin.classify(brute.documents(spark, rows))
    assert by_row(members, "doc_id", "n_shingles", "component_id") == want((r[0], *x) for r, x in zip(rows, brute.near([r[:2] for r in rows]), strict=True))
    if light is None:
        assert links.where("a >= b").count() == 0
        assert setjoin.classify(empty(docs))[0].count() == 0


def test_shingles_are_the_sets():
    random.seed(3)
    bits = ["a", "B", "b", "É", "é", "x\x1fy", " ", " ", "\t", "\n", "  ", "cc", "\x85"]
    texts = [None, "", "   ", *(" ".join(random.choices(bits, k=random.randint(0, 30))) for _ in range(2000))]
    seen: dict = {}
    for t, s in zip(texts, setjoin.shingle_sets(texts), strict=True):
        b = frozenset(brute.shingles(t))
        assert len(b) == len(s) and seen.setdefault(b, s.tobytes()) == s.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_size_bounds():
    for a in range(1, 80):
        for b in range(a, 100):
            feasible = any(100 * i >= 85 * (a + b - i) for i in range(a + 1))
            assert feasible == (b in setjoin.partners(a)) or (feasible and setjoin.least_overlap(a, b) <= a)
            if feasible:
                i = setjoin.least_overlap(a, b)
                assert 100 * i >= 85 * (a + b - i) and not 100 * (i - 1) >= 85 * (a + b - i + 1)
                assert setjoin.prefix_length(a) + i > a and abs(setjoin.band(a) - setjoin.band(b)) <= 1


def test_syncmers(spark, docs):
    got = syncmers.compare_edits(syncmers.in_order(docs, buckets=5)).collect()
    ordered = sorted(((r[0], r[1] or "") for r in brute.ROWS), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    expected = []
    for i, (doc_id, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)][1]
        n = len(t) // 2
        expected.append((doc_id, len(t), brute.digest(t[: len(t) - n] + nxt[:n]), syncmers.write(syncmers.sketch(t))))
    assert sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"])) for r in got) == want(expected)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        a, b = syncmers.parse(r["fingerprint"]), syncmers.parse(r["edited_fingerprint"])
        assert r["near_edited"] == syncmers.likeness(a, b)
    assert syncmers.compare_edits(syncmers.in_order(empty(docs))).count() == 0


def test_syncmers_are_closed():
    random.seed(6)
    text = "".join(random.choices("abcd ", k=400))
    hashes, at = syncmers.anchors(text)
    k, s = syncmers.K, syncmers.S
    inner = lambda x: syncmers._windows(np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.uint64), s)[0]
    chosen = {i for i in range(len(text) - k + 1) for m in ([inner(text[j : j + s]) for j in range(i, i + k - s + 1)],) if min(m) in (m[0], m[-1])}
    assert {text[p : p + k] for p in at.tolist()} == {text[p : p + k] for p in chosen}
    # Context-free: a passage keeps its anchors in another text.
    part = set(syncmers.anchors(text[100:300])[0].tolist())
    assert part <= set(syncmers.anchors("zzz" + text[100:300] + "yyy")[0].tolist())


def test_quality_model(spark, data, docs):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_model.fit(d, labels)
    scored = quality_model.score(d, model).withColumn("held", quality_model.held_out(F.col("doc_id"))).join(labels, "doc_id").where("held").toPandas()
    assert ((scored.score >= 0.3) == (scored.quality == 1)).mean() > 0.95
    x = scored[list(quality_model.STATISTICS)].to_numpy(float)
    assert np.allclose(model.predict(x), scored.score)
    odd = quality_model.score(docs, model).select("score").collect()
    assert len(odd) == len(brute.ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_model.score(empty(docs), model).count() == 0
    assert quality_model.fit(d, labels.limit(0)).column() is not None and quality_model.fit(d, labels.where("quality = 1")).bias > 0
    assert quality_model.fit(d, labels) == model
