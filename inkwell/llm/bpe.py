"""BPE encoding and decoding by a prefix-sharing trie of the distinct words.

The distinct words of a batch go in order into a trie whose edges are the
symbols that merging starts from. A depth-first walk, made while the trie grows,
gives each node the last token of its prefix's encoding: the encoding of a
prefix is that of a shorter prefix and one more token, and exactly one token
fits behind the shorter prefix's last token. So a prefix that many words share is
encoded once, and only one branch is in memory. Words already encoded are kept
in a bounded table of each Python worker until its task ends: an idle worker
stays in its executor's memory through the stages that follow.

The normalizer and the splitting into words come from the tokenizer's file, as
do its special tokens, which are recognised in the raw text.

Defined results: a null or empty text has no tokens. Repeated rows give
repeated, equal results. Extra columns are left out, so names cannot clash.
"""

from __future__ import annotations

import ctypes
import json
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise
from os.path import commonprefix
from struct import pack
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Chunks of a worker's table, characters in them, and words, after which each table starts anew.
KEPT_CHUNKS, KEPT_CHARS, KEPT_WORDS = 200_000, 10_000_000, 300_000
#: Characters of the texts whose distinct words share a trie, and rows at most.
SLICE_CHARS, SLICE_ROWS = 2_000_000, 2048
#: A text of these characters only is in NFC, and str.lower() and str.split() agree with the normalizer on it.
_ODD = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]")
#: The one splitting pattern that is also compiled for Python, over the letters and numbers below U+0250.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(kinds: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x250) if category(chr(i))[0] in kinds)


_PLAIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\t-\r \x85\xa0{_class('LN')}]+")

SCHEMA = "doc_id bigint, ids array<int>"


class PairCheck:
    """Says which tokens may follow each other, and encodes words by that.

    ``merges`` lists (left, right, product) token ids in the order of the merges,
    and a product's rank is its place in that list; base symbols rank below all.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = r
            if whole in self.parts:
                raise ValueError(f"two merges make {a + b!r}; the last-token states need one")
            self.parts[whole], self.made_at[whole] = (vocab[a], vocab[b]), r
        self.known: dict[int, bool] = {}
        self.longest = max((len(t) for t in vocab), default=1)
        self.by_id = {i: t for t, i in vocab.items()}
        # A token that its own string is not encoded as never occurs.
        self.never = {i for i in self.parts if self.naive(self.symbols(self.by_id[i])) != [i]}

    def symbols(self, word: str) -> list[str]:
        body = word.removesuffix(self.end) if self.end else word
        return [*body[:-1], body[-1] + word[len(body) :]] if body else []

    def naive(self, symbols: list[str]) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, as long as there is one."""
        ids = [self.vocab[s] for s in symbols]
        while len(ids) > 1:
            r, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if r == 1 << 60:
                break
            ids[at : at + 2] = [self.vocab[self.by_id[ids[at]] + self.by_id[ids[at + 1]]]]
        return ids

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge joins the two across their border while each is being made."""
        pair = left << 20 | right
        if pair not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[pair] = self._fits(left, right)
        return self.known[pair]

    def _fits(self, left: int, right: int) -> bool:
        # Undo the latest merge of either side step by step. A pair that faces each other until rank `until`
        # must not be joined by a merge before that.
        until = 1 << 60
        while True:
            if self.rank.get((left, right), 1 << 60) < until:
                return False
            a, b = self.made_at.get(left, -1), self.made_at.get(right, -1)
            if a < 0 and b < 0:
                return True
            # Of two equal products the left one is merged first, so the right one is undone first.
            if a > b:
                until, left = a, self.parts[left][1]
            else:
                # A merge of the same rank to the left of the right token's own comes before it.
                until, right = b + 1, self.parts[right][0]

    def encode_all(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each word; every shared prefix is walked once.

        The words go into the trie in order, so a branch is complete when a word
        leaves it: the trie is walked as it grows, and only the branch at hand is kept.
        """
        found: dict[str, list[int]] = {}
        path = ""
        last: list[int] = []  # the last token of the prefix's encoding at each depth of the branch
        width: list[int] = []  # and how many symbols it spans
        for word in sorted(words):
            if not word:
                continue
            body = word[:-1]
            shared = len(commonprefix((path, body)))
            del last[shared:], width[shared:]
            for depth in range(shared, len(body)):
                t, start = self._ending(body, depth, body[depth], last)
                last.append(t)
                width.append(depth + 1 - start)
            path, start = body, len(body)
            t, start = self._ending(body, start, word[-1] + self.end, last)
            out = [t]
            while start:
                out.append(last[start - 1])
                start -= width[start - 1]
            found[word] = out[::-1]
        return found

    def _ending(self, path: str, at: int, symbol: str, last: list[int]) -> tuple[int, int]:
        """The token that ends with the symbol behind the first ``at`` symbols of the path, and where it starts: exactly one fits."""
        vocab, known, never = self.vocab, self.known, self.never
        piece, start = symbol, at
        while True:
            t = vocab.get(piece)
            if t is not None and t not in never:
                if not start:
                    return t, 0
                ok = known.get(last[start - 1] << 20 | t)
                if self.fits(last[start - 1], t) if ok is None else ok:
                    return t, start
            start -= 1
            if start < 0 or at - start >= self.longest:
                raise ValueError(f"no token ends {path[:at] + symbol!r}")
            piece = path[start] + piece


class Codec:
    """Encodes and decodes texts as the tokenizer's file says, without its own BPE."""

    def __init__(self, model_json: str):
        from tokenizers import Tokenizer

        spec = json.loads(model_json)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("only plain BPE models without a decoder are supported")
        # Only the normalizer and the splitter of the library's tokenizer are used, so it gets no vocabulary.
        own = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.normalize, self.split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = PairCheck(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("only plain added tokens are supported")
        if max(model["vocab"].values()) >= 1 << 20:
            raise ValueError("token ids must be below 2 to the power 20")
        self.special = {t["content"]: t["id"] for t in added}
        self.special_split = re.compile("(" + ("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)") + ")")
        self.token = self.pairs.by_id | {i: s for s, i in self.special.items()}
        steps = spec["pre_tokenizer"].get("pretokenizers", [{}])
        rules = [n["type"] for n in spec["normalizer"].get("normalizers", [])]
        self.plain = steps[0].get("pattern") == {"Regex": _KNOWN_SPLIT} and rules == ["NFC", "Replace", "Lowercase"]
        # Bytes as the tokenizer writes them: printable ones as they are, the others from U+0100 on.
        own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
        rest = [b for b in range(256) if b not in own]
        self.byte_chars = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.chunks, self.words = Table(), {}
        # The tokens' strings with the space that decoding puts between them.
        self.strings = Table()
        self.strings.put([(" " + self.token[i]).encode() if i in self.token else b"" for i in range(max(self.token) + 1)])

    def rest(self) -> None:
        """Empty the tables; an idle worker keeps only what the file says."""
        self.chunks, self.words = Table(), {}
        self.pairs.known.clear()

    def _parts(self, text: str) -> list[str]:
        """The text without its special tokens, with those as every other part."""
        return self.special_split.split(text) if "<" in text else [text]

    def _chunks(self, text: str) -> list[str]:
        """What stands between white space; words that the library has split and written in bytes start with NUL."""
        if self.plain and not _ODD.search(text):
            return text.lower().split()
        return ["\0" + w for w, _ in self.split(self.normalize(text))]

    def _written(self, chunk: str) -> list[str]:
        """The chunk's words, in the letters that stand for bytes."""
        if chunk[0] == "\0":
            return [chunk[1:]]
        if chunk.isascii():
            return [chunk] if chunk.isalpha() else _PLAIN_SPLIT.findall(chunk)
        return [w.encode().decode("latin-1").translate(self.byte_chars) for w in _PLAIN_SPLIT.findall(chunk)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, from one trie of the batch's new words."""
        if len(self.chunks) > KEPT_CHUNKS or self.chunks.chars > KEPT_CHARS:
            self.chunks = Table()
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        parts = [self._parts(t) for t in texts]
        codes: list[np.ndarray] = []
        ends = []
        chunks = self.chunks
        n = 0
        for ps in parts:
            for i, p in enumerate(ps):
                if i % 2:
                    codes.append(np.array([chunks["\1" + p]]))
                elif p:
                    own = self._chunks(p)
                    codes.append(np.fromiter(map(chunks.__getitem__, own), np.int64, len(own)))
                else:
                    continue
                n += len(codes[-1])
            ends.append(n)
        written = [c if c[0] == "\1" else self._written(c) for c in chunks.new]
        made = self.pairs.encode_all({w for ws in written if ws.__class__ is list for w in ws if w not in self.words})
        self.words.update((w, pack(f"<{len(x)}I", *x)) for w, x in made.items() if len(w) <= 64)
        long = {w: pack(f"<{len(x)}I", *x) for w, x in made.items() if len(w) > 64}
        get = (lambda w: self.words.get(w) or long[w]) if long else self.words.__getitem__
        chunks.put([b"".join(map(get, ws)) if ws.__class__ is list else pack("<I", self.special[ws[1:]]) for ws in written])
        flat, at = chunks.take(np.concatenate(codes) if codes else np.empty(0, np.int64))
        return [np.frombuffer(flat[a:b], "<u4") for a, b in pairwise([0, *at[ends].tolist()])]

    def decode_batch(self, ids: list[np.ndarray]) -> list[bytes]:
        """The tokens' strings, joined as the library joins those of a file without a decoder, in UTF-8."""
        flat, at = self.strings.take(np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64))
        return [flat[a + 1 : b].tobytes() for a, b in pairwise([0, *at[np.cumsum([len(x) for x in ids])].tolist()])] if ids else []


class Table(dict):
    """Numbers new keys as they are looked up; take() gathers the bytes put for them."""

    def __init__(self):
        self.new: list[str] = []
        self.chars = 0
        self.held = pa.array([], pa.large_binary())

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def put(self, rows: list[bytes]) -> None:
        """The bytes of the new keys, in order."""
        self.chars += sum(map(len, self.new))
        self.held = pa.concat_arrays([self.held, pa.array(rows, pa.large_binary())])
        self.new = []

    def take(self, codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The codes' bytes one behind the other, and the offset of each code with the end."""
        got = self.held.take(pa.array(codes))
        at = np.frombuffer(got.buffers()[1], np.int64, len(codes) + 1, got.offset * 8) if len(codes) else np.zeros(1, np.int64)
        return memoryview(got.buffers()[2] or b"") if len(codes) else memoryview(b""), at


_CODECS: dict[int, Codec] = {}


def codec(shared) -> Codec:
    """The worker's codec; shared is the broadcast text of the tokenizer's file."""
    if shared.value[0] not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.value[0]] = Codec(shared.value[1])
    return _CODECS[shared.value[0]]


def share(spark, path: str):
    """Broadcast the tokenizer's file; its size is fixed by the vocabulary."""
    from zlib import crc32

    with open(path, encoding="utf-8") as f:
        text = f.read()
    return spark.sparkContext.broadcast((crc32(text.encode()), text))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of few rows and not many more characters than stated."""
    for whole in batches:
        at = 0
        ends = np.cumsum(pc.binary_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        while at < whole.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_CHARS))
            n = min(SLICE_ROWS, max(1, upto - at))
            yield whole.slice(at, n)
            at += n


def _give_back() -> None:
    """Return freed memory to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    c = codec(shared)
    for part in _slices(batches):
        yield part, c.encode_batch([t or "" for t in part.column(1).to_pylist()])
    c.rest()
    _give_back()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every whole text."""
    shared = share(df.sparkSession, path)

    def run(batches):
        for part, ids in _rows(batches, shared):
            ends = np.cumsum([0, *(len(x) for x in ids)]).astype("<i4")
            values = pa.array(np.concatenate(ids).astype("<i4") if ids else np.empty(0, "<i4"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, SCHEMA)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded string of every row's ids (null: none)."""
    shared = share(df.sparkSession, path)

    def run(batches):
        c = codec(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                texts = c.decode_batch([np.array(x or [], np.int64) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "decoded"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{ids_col}` as ids").mapInArrow(run, "doc_id bigint, decoded string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, digests only."""
    from hashlib import sha256

    shared = share(df.sparkSession, path)

    def run(batches):
        c = codec(shared)
        for part, ids in _rows(batches, shared):
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([sha256(x).hexdigest() for x in c.decode_batch(ids)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
