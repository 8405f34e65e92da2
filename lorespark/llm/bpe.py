"""BPE encoding by forced boundaries: cut where no token can reach across, encode the pieces one by one, concatenate."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import session_of, ship_code, text_of

#: Entries of each worker's memo of encoded chunks; it only saves time.
MEMO = 300_000
#: Rows that a worker holds in expanded form at once.
ROWS = 128
#: Printable ASCII and accented letters that are composed already, of which each lower-cases to one letter.
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_LATIN_PIECE = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+")


def _byte_symbols() -> list[str]:
    """Byte-level symbols: visible Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


# The settings of a tokenizers file that this module encodes by.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SUPPORTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
SUPPORTED_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
SUPPORTED_TOKEN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}


def check_supported(spec: dict) -> None:
    """Raises for a file whose settings differ from those that this module encodes by: its results would be wrong."""
    parts = [(SUPPORTED, spec, "file"), (SUPPORTED_MODEL, spec["model"], "model"), *((SUPPORTED_TOKEN, t, f"token {t['content']!r}") for t in spec["added_tokens"])]
    for wanted, given, where in parts:
        for k, v in wanted.items():
            if (given.get(k) or None) != (v or None):
                raise ValueError(f"{where}: {k} is {given.get(k)!r}; supported is {v!r}")


_SYMBOLS = _byte_symbols()
_BYTES = {c: b for b, c in enumerate(_SYMBOLS)}
#: From a byte, as a Latin-1 character, to its symbol; the space stays as the separator of words.
_TO_SYMBOL = {b: ord(c) for b, c in enumerate(_SYMBOLS) if b != 32 and b != ord(c)}


def _codes(symbols: str) -> np.ndarray:
    return np.frombuffer(symbols.encode("utf-16-le"), np.uint16)


def _fragment_coder(vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
    from tokenizers import Tokenizer, models, pre_tokenizers

    coder = Tokenizer(models.BPE(vocab=vocab, merges=merges, **({"end_of_word_suffix": end} if end else {})))
    coder.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return coder


class ForcedBoundaryBPE:
    """Encodes as the tokenizers library does with this file, for BPE models with a word-end suffix.

    reach[a, b] tells whether the symbols a, b of bytes stand side by side inside any token. Every symbol that merging can form is a
    token, so where reach is false no merge crosses and the two sides can be encoded apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_supported(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t.decode() for t, i in self.special.items()}
        self.split_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.reach = np.zeros((512, 512), bool)
        for t in vocab:
            body = _codes(t.removesuffix(end) if end and t != end else t)
            self.reach[body[:-1], body[1:]] = True
        self.reach[:, ord(" ")] = self.reach[ord(" "), :] = True
        # fragments that end a word, and fragments that do not
        self.coders = [_fragment_coder(vocab, merges, end), _fragment_coder(vocab, merges, "")]
        # the newer and the older half: what is used moves to the newer, and the older goes when that is full
        self.memo: dict[bytes, tuple[bytes, str]] = {}
        self.older: dict[bytes, tuple[bytes, str]] = {}

    def cuts(self, words: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The fragments of words (in byte symbols, a space between words), whether each ends its word, and its word's number."""
        codes = _codes(words)
        forced = np.flatnonzero(~self.reach[codes[:-1], codes[1:]]) + 1
        cut = "\n".join([words[i:j] for i, j in zip([0, *forced.tolist()], [*forced.tolist(), len(words)])]) if len(forced) else words
        marks = _codes(cut)
        ends = marks[(marks == 32) | (marks == 10)] == 32
        last = np.append(ends, True)
        return cut.replace("\n", " ").split(" "), last, np.cumsum(np.append(0, ends))

    def pieces(self, chunks: list[str]) -> list[str]:
        """The words of stretches without ASCII white space, with a line feed after each stretch but the last.

        Nothing in normalising or splitting reaches across white space.
        """
        if all(map(_LATIN.fullmatch, chunks)):
            return _LATIN_PIECE.findall("\n".join(chunks).lower())
        normalise, split = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        out: list[str] = []
        for c in chunks:
            # the library gives byte symbols; bytes are wanted here
            out += [bytes(map(_BYTES.__getitem__, p)).decode() for p, _ in split(normalise(c))]
            out.append("\n")
        return out[:-1]

    def learn(self, chunks: set[bytes]) -> None:
        """Encodes chunks that are not in the memo: their fragments go apart through the merges, then are put together."""
        texts = list(map(bytes.decode, chunks))
        plain = [c for c in texts if _LATIN.fullmatch(c)]
        other = [c for c in texts if not _LATIN.fullmatch(c)] if len(plain) < len(texts) else []
        for some in (plain, other):
            if some:
                self._learn(some, self.pieces(some))

    def _learn(self, chunks: list[str], pieces: list[str]) -> None:
        breaks = np.fromiter((p == "\n" for p in pieces), bool, len(pieces))
        owner = np.cumsum(breaks)[~breaks]
        words = " ".join([p for p in pieces if p != "\n"]).encode().decode("latin-1").translate(_TO_SYMBOL)
        if len(owner):
            fragments, last, word = self.cuts(words)
            ids, place = [], []
            for coder, those in zip(self.coders, (last, ~last)):
                at = np.flatnonzero(those)
                if len(at):
                    encoded = coder.encode(" ".join(fragments if len(at) == len(fragments) else [fragments[i] for i in at.tolist()]), add_special_tokens=False)
                    ids.append(np.array(encoded.ids, np.int32))
                    place.append(at[np.array(encoded.word_ids, np.int64)])
            if len(ids) > 1:
                order = np.argsort(np.concatenate(place), kind="stable")
                flat, of = np.concatenate(ids)[order], np.concatenate(place)[order]
            else:
                flat, of = ids[0], place[0]
            ends = np.searchsorted(owner[word[of]], np.arange(len(chunks)), "right").tolist()
        else:
            flat, ends = np.empty(0, np.int32), [0] * len(chunks)
        names, packed, start = list(map(self.names.__getitem__, flat.tolist())), flat.tobytes(), 0
        for c, stop in zip(chunks, ends):
            self.memo[c.encode()] = packed[4 * start : 4 * stop], " ".join(names[start:stop])
            start = stop

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        """Ids as 32-bit numbers in a row, and what they decode to: the file names no decoder, so tokens joined by spaces."""
        return array("i", ids).tobytes(), " ".join(map(self.names.__getitem__, ids))

    def encode_all(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        """Packed ids and decoded text of each UTF-8 text."""
        split = [[(p, None) if special else (p, p.split()) for special, p in self._parts(t)] for t in texts]
        needed = {c for each in split for _, chunks in each if chunks for c in chunks}
        if len(self.memo) > MEMO // 2:
            self.memo, self.older = {}, self.memo
        needed.difference_update(self.memo)
        seen = needed.intersection(self.older)
        self.memo.update((c, self.older[c]) for c in seen)
        self.learn(needed - seen)
        get, out = self.memo.__getitem__, []
        for each in split:
            found = [x for p, chunks in each for x in ([self._packed([self.special[p]])] if chunks is None else map(get, chunks))]
            out.append((b"".join([i for i, _ in found]), " ".join([d for _, d in found if d])))
        return out

    def _parts(self, text: bytes) -> list[tuple[int, bytes]]:
        """The text between special tokens, and those tokens: (0, text) and (1, token) by turns."""
        if b"<" in text and self.split_special and self.split_special.search(text):
            return [(k % 2, p) for k, p in enumerate(self.split_special.split(text))]
        return [(0, text)]

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_all([text.encode()])[0][0]).tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def model(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def bpe(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id, ids (array of int), decoded (the ids decoded again, special tokens included).

    path: a tokenizers JSON file with the settings of SUPPORTED (another raises ValueError), present on every executor. A null or empty text gives
    an empty array and an empty string; repeated rows are encoded each; texts of any length are encoded whole. An empty
    table gives no rows. Other columns are ignored.
    """
    ship_code(session_of(docs))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm.bpe import ROWS, model
        from lorespark.llm.common import only

        only("bpe")
        coder = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                each = coder.encode_all(part.column(1).to_pylist())
                offsets = np.cumsum([0, *(len(i) // 4 for i, _ in each)], dtype=np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join([i for i, _ in each]))])
                ids = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([d for _, d in each], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(encode, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
