"""Token counts with a whole-token shortcut, for byte-level BPE tokenizer files.

``whole_tokens`` proves on the driver which vocabulary strings encode alone as one token: the string is one match
of the pre-token pattern and the model's own merges lead to a single token. Such pre-tokens count one each without
a merge; only the rest is merged, each distinct pre-token once while it is in a task's bounded cache. The special
strings of the file are found first, as the library does by default, count one each, and cut the text.

Map-only: documents are neither shuffled nor kept, so hot sources and long texts cost their own length alone.

Cases: null texts count as empty (0 bytes, 0 tokens); ids may be null or repeated, each row is counted by itself;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches
from .pretokens import fragments, pattern, spaced

CACHE = 250_000


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_TABLE = byte_chars()


def model_text(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_TABLE)


def checked(config: str) -> list[str]:
    """The special strings of a tokenizer file; raises where the file isn't plain byte-level BPE."""
    c = json.loads(config)
    pre = c.get("pre_tokenizer") or {}
    if c.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or c["model"].get("type") != "BPE" or c["model"].get("dropout"):
        raise ValueError("token counts need a plain byte-level BPE tokenizer file")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in c["added_tokens"]):
        raise ValueError("special strings that take their surroundings aren't provided for")
    return [t["content"] for t in c["added_tokens"]]


def whole_tokens(config: str) -> frozenset[str]:
    """The vocabulary strings that are proved to encode alone as one token."""
    from tokenizers import Tokenizer

    model, find = Tokenizer.from_str(config).model, pattern().findall
    back = {c: b for b, c in _TABLE.items()}
    out = set()
    for t in json.loads(config)["model"]["vocab"]:
        try:
            s = bytes(back[c] for c in t).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if find(s) == [s] and len(model.tokenize(t)) == 1:
            out.add(s)
    return frozenset(out)


class _Counter:
    def __init__(self, config: str, whole: frozenset[str]):
        import re

        from tokenizers import Tokenizer

        self.model, self.find, self.whole = Tokenizer.from_str(config).model, pattern().findall, whole
        special = checked(config)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special
        self.merged: dict[str, int] = {}
        self.cache: dict[str, int] = {}

    def piece(self, p: str) -> int:
        if p in self.whole:
            return 1
        n = self.merged.get(p)
        if n is None:
            if len(self.merged) >= CACHE:
                self.merged.clear()
            n = len(self.model.tokenize(model_text(p)))
            if len(p) < 100:
                self.merged[p] = n
        return n

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if len(self.cache) >= CACHE:
            self.cache.clear()
        first, *rest = fragments(text)
        get, n = self.cache.get, 0
        for c, f in zip(map(get, rest), rest):
            n += self.spaced(f) if c is None else c
        return n + sum(map(self.piece, self.find(first)))

    def spaced(self, f: str) -> int:
        n = sum(map(self.piece, spaced(f, self.find)))
        if len(f) < 100:
            self.cache[f] = n
        return n

    def text(self, text: str) -> int:
        if self.special and any(m in text for m in self.marks):
            found = self.special.findall(text)
            return len(found) + sum(map(self.plain, self.special.split(text)))
        return self.plain(text)


def count_tokens(docs: DataFrame, config: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of docs. config: the content of the tokenizer's JSON file."""
    spark = docs.sparkSession
    checked(config)
    small_batches(spark)
    shared = spark.sparkContext.broadcast((config, whole_tokens(config)))  # of a vocabulary's size

    def run(batches):
        counter = _Counter(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([counter.text(t.as_py()) for t in b.column(1)], pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)
