"""Token ids and token counts with public tokenizer files.

Byte-level BPE files are encoded through a piece cache: a text is cut at blanks that stand between two non-blank
characters. At such a blank the pre-tokenizer always begins a new unit and never looks back, so the ids of a text are
the ids of its pieces in a row. New pieces of a batch are encoded by the library in one joined string and cut apart
again at the tokens that begin with a blank. Texts with other blanks (runs, line ends beside blanks) keep those
stretches together. Other tokenizers encode whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
CACHE_BYTES, ENTRY_BYTES = 1 << 27, 180
LONG_PIECE = 128


class Encoder:
    """Encodes texts with one tokenizer file; ``ids`` gives little-endian uint32 bytes, ``counts`` lengths."""

    def __init__(self, path: str, ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.ids, self.cache, self.size, self.cut = ids, {}, 0, False
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.many = lambda texts: sp.encode(texts, num_threads=1)
            return
        import json

        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        if ids:
            self.many = lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            self.many = lambda texts: tok.encode_batch_fast(texts, add_special_tokens=False)
        self.raw = lambda text: tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre = conf.get("pre_tokenizer") or {}
        stripping = any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in conf.get("added_tokens", []))
        self.cut = not conf.get("normalizer") and not stripping and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space")
        if self.cut:
            self.blank = np.array([(tok.id_to_token(i) or "").startswith("Ġ") for i in range(tok.get_vocab_size())])

    def value(self, encoded) -> bytes | int:
        return np.asarray(encoded, dtype="<u4").tobytes() if self.ids else len(encoded)

    def whole(self, texts: list[str]) -> list:
        return [self.value(x) for x in self.many(texts)]

    def learn(self, words: set[str]) -> None:
        """Put what the blank-led words encode to into the cache; None marks words that can't stand alone."""
        new = []
        for w in words:
            if not w or w[0].isspace() or w[-1].isspace():
                self.cache[w] = None
            else:
                new.append(w)
        for i in range(0, len(new), 256):
            part = new[i : i + 256]
            got = np.asarray(self.raw(" " + " ".join(part)), dtype="<u4")
            at = np.flatnonzero(self.blank[got])
            if len(at) != len(part):  # a blank inside a piece: encode each alone
                self.cache.update(zip(part, self.whole([" " + w for w in part]), strict=True))
            elif self.ids:
                raw, at = got.tobytes(), [*(at * 4).tolist(), got.nbytes]
                self.cache.update((w, raw[a:b]) for w, a, b in zip(part, at, at[1:], strict=False))
            else:
                self.cache.update(zip(part, np.diff(at, append=len(got)).tolist(), strict=True))

    def stretches(self, words: list[str], led: bool) -> list:
        """Values of words that include some which can't stand alone: those are joined with their neighbours."""
        out, i, n = [], 0, len(words)
        open_ = lambda a, b: not a or not b or a[-1].isspace() or b[0].isspace()
        while i < n:
            j = i
            while j + 1 < n and open_(words[j], words[j + 1]):
                j += 1
            if j == i and (i or led) and words[i] and self.cache.get(words[i]) is not None:
                out.append(self.cache[words[i]])
            else:
                out += self.whole([(" " if i or led else "") + " ".join(words[i : j + 1])])
            i = j + 1
        return out

    def slices(self, text: str) -> Iterator[str]:
        """A long text cut at safe blanks; all but the first begin with their blank."""
        at = 0
        while len(text) - at > BATCH_BYTES:
            to = text.find(" ", at + BATCH_BYTES)
            while to > 0 and to + 1 < len(text) and (text[to - 1].isspace() or text[to + 1].isspace()):
                to = text.find(" ", to + 1)
            if to < 0 or to + 1 >= len(text):
                break
            yield text[at:to]
            at = to
        yield text[at:]

    def batch(self, texts: list[str]) -> list:
        """Values of texts of one batch."""
        if not self.cut:
            return self.whole(texts)
        parts = [(k, i > 0, s[1:] if i else s) for k, t in enumerate(texts) for i, s in enumerate(self.slices(t))]
        words = [s.split(" ") for _, _, s in parts]
        new = set().union(*words).difference(self.cache)
        self.learn(new)
        heads = iter(self.whole([w[0] for w, (_, led, _) in zip(words, parts, strict=True) if not led]))
        out = [b"" if self.ids else 0] * len(texts)
        get = self.cache.get
        for w, (k, led, _) in zip(words, parts, strict=True):
            head = None if led else next(heads)
            got = list(map(get, w if led else w[1:]))
            if None in got or not led and len(w) > 1 and (not w[0] or w[0][-1].isspace()):
                got = self.stretches(w, led)
            elif not led:
                got.append(0 if not self.ids else b"")
                got.insert(0, head)
            out[k] += b"".join(got) if self.ids else sum(got)
        for w in new:
            if len(w) > LONG_PIECE:
                self.cache.pop(w, None)
            else:
                self.size += len(w) + ENTRY_BYTES
        if self.size > CACHE_BYTES:
            self.cache.clear()
            self.size = 0
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, ids: bool) -> Encoder:
    """The worker's encoder; workers are reused, so its cache serves later tasks too."""
    if (path, ids) not in _ENCODERS:
        _ENCODERS[path, ids] = Encoder(path, ids)
    return _ENCODERS[path, ids]


def encoded(texts: pa.Array, path: str, ids: bool) -> Iterator[bytes | int]:
    """Values of a column in batches of about BATCH_BYTES; null texts are empty."""
    enc, texts = encoder(path, ids), pc.fill_null(texts, "")
    sizes, a, total = pc.binary_length(texts).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= BATCH_BYTES or i + 1 == len(sizes):
            yield from enc.batch(texts.slice(a, i + 1 - a).to_pylist())
            a, total = i + 1, 0


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, n_bytes, n_tokens, over_limit``: UTF-8 bytes and tokens of the whole text.

    Lengths leave the workers, ids don't. No shuffle; rows of a batch are dealt by bytes. Null texts count as empty
    (0, 0, false), null ids stay null, repeated rows give repeated results, an empty table gives an empty one; other
    columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter(encoded(b.column(1), tokenizer, False), dtype=np.int64, count=b.num_rows)
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
