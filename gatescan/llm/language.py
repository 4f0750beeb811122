"""Operator 9: language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of orders 2, 1 and 0 is counted over all training rows in Spark and then frozen. A byte's
code length follows the tree: if it was seen after the two bytes before it, its share there (method C: each context also
reserves its number of distinct followers for an escape); else an escape to the shorter context, where what the longer one has
seen is excluded; below order 0 all bytes not seen there are equal. The code lengths of all contexts fill one exact table,
of (distinct bytes + 1)**3 numbers a language (at most 68 MB; a few MB for alphabetic text), and a text's cost in a language is
a sum over it. The language of the smallest cost wins; the score is its posterior under equal priors.

Defined cases: null text, or text without a letter, is `und` with score 0; so is everything if there are no training rows. Ties
go to the language first in order. Bytes unseen in training cost their escapes and the uniform rest. Rows are independent, repeated
ones repeat their results; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatescan.llm.bpe import blocks, raw_texts

UNKNOWN = "und"


def _trigrams(texts: list[bytes]) -> np.ndarray:
    """Each byte with the two before it, as 9-bit symbols (256: before the start), for all texts in order."""
    pad = np.array([256, 256], dtype=np.uint32)
    n = sum(map(len, texts))
    if not n:
        return np.empty(0, dtype=np.uint32)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    begins = np.cumsum([0] + [len(t) for t in texts])[:-1]
    begins = np.array([b for b, t in zip(begins.tolist(), texts, strict=True) if t])
    one, two = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    one[1:], two[2:] = data[:-1], data[:-2]
    two[:2] = 256
    one[begins], two[begins] = pad
    second = begins + 1
    two[second[second < n]] = 256
    one[begins] = 256  # a text of one byte may have been set as another's second
    return two << 18 | one << 9 | data


def count_trigrams(rows: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, trigram int, n long) over all rows with both columns, counted in each task first."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for whole in batches:
            for b in blocks(whole, "t"):
                langs = np.array(b.column(0).to_pylist(), dtype=object)
                texts = raw_texts(b.column(1))
                for lang in sorted(set(langs.tolist())):
                    got = np.unique(_trigrams([t for t, x in zip(texts, langs.tolist(), strict=True) if x == lang]), return_counts=True)
                    held.setdefault(lang, []).append(got)
                    if len(held[lang]) > 16:
                        held[lang] = [_merge(held[lang])]
        for lang, parts in held.items():
            keys, n = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "trigram", "n"])

    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).mapInArrow(run, "lang string, trigram int, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def code_lengths(count: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Bits of each symbol after each pair of symbols, from count[two before, one before, symbol].

    real marks the symbols that are bytes; symbol 0 stands for the text's start in contexts and for any unseen byte.
    """
    size = count.shape[0]
    c2 = count.astype(np.float64)
    c1, c0 = c2.sum(axis=0), c2.sum(axis=(0, 1))
    seen2, seen1, seen0 = c2 > 0, c1 > 0, c0 > 0
    rest = max(1, 256 - int(seen0[real].sum()))
    with np.errstate(divide="ignore", invalid="ignore"):
        n2, d2 = c2.sum(axis=2), seen2.sum(axis=2)
        total2 = n2 + d2
        bits = np.where(seen2, np.log2(total2[:, :, None] / c2), 0.0)
        escape2 = np.where(total2 > 0, np.log2(total2 / np.maximum(d2, 1)), 0.0)
        # order 1, without what order 2 has seen
        fresh1 = seen1[None, :, :] & ~seen2
        n1 = np.einsum("abs,bs->ab", fresh1, c1)
        d1 = fresh1.sum(axis=2)
        total1 = n1 + d1
        bits += np.where(fresh1, escape2[:, :, None] + np.log2(total1[:, :, None] / np.where(c1 > 0, c1, 1)[None]), 0.0)
        escape1 = escape2 + np.where(total1 > 0, np.log2(total1 / np.maximum(d1, 1)), 0.0)
        # order 0, without what order 1 has seen
        fresh0 = seen0[None, :] & ~seen1
        total0 = (fresh0 * c0).sum(axis=1) + fresh0.sum(axis=1)
        own0 = np.where(fresh0, np.log2(total0[:, None] / np.where(c0 > 0, c0, 1)), 0.0)
        bits += np.where(fresh0[None], escape1[:, :, None] + own0[None], 0.0)
        escape0 = escape1 + np.where(total0 > 0, np.log2(total0 / np.maximum(fresh0.sum(axis=1), 1)), 0.0)[None]
        bits += np.where((~seen0)[None, None, :], escape0[:, :, None] + np.log2(rest), 0.0)
    assert bits.shape == (size, size, size)
    return bits


class Model:
    """Frozen code lengths of all languages: table[symbol pair and symbol, language]."""

    def __init__(self, rows: pa.Table):
        keys = rows.column("trigram").to_numpy().astype(np.int64)
        n, lang = rows.column("n").to_numpy(), np.array(rows.column("lang").to_pylist(), dtype=object)
        self.languages = sorted(set(lang.tolist()))
        used = np.unique(keys & 511)
        self.size = len(used) + 1
        self.symbol = np.zeros(512, dtype=np.int64)
        self.symbol[used] = np.arange(1, self.size)
        real = np.arange(self.size) > 0
        self.table = np.empty((self.size**3, len(self.languages)), dtype=np.float32)
        s = self.symbol
        for k, name in enumerate(self.languages):
            own = lang == name
            count = np.zeros((self.size,) * 3, dtype=np.int64)
            np.add.at(count, (s[keys[own] >> 18], s[keys[own] >> 9 & 511], s[keys[own] & 511]), n[own])
            self.table[:, k] = code_lengths(count, real).reshape(-1)

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        full = [k for k, t in enumerate(texts) if t]
        if not full:
            return out
        g = _trigrams(texts)
        s = self.symbol.astype(np.int32)
        at = (s[g >> 18] * self.size + s[g >> 9 & 511]) * self.size + s[g & 511]
        begins = np.cumsum([0] + [len(texts[k]) for k in full])[:-1]
        for lang in range(len(self.languages)):
            out[full, lang] = np.add.reduceat(self.columns()[lang][at], begins, dtype=np.float64)
        return out

    def columns(self) -> list[np.ndarray]:
        if not hasattr(self, "_columns"):
            self._columns = [np.ascontiguousarray(self.table[:, k]) for k in range(self.table.shape[1])]
        return self._columns


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of all rows that have a language and a text. What reaches the driver is bounded by the distinct byte
    trigrams of each language, not by the rows."""
    return Model(count_trigrams(rows, lang_col, text_col).toArrow())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, suffix: str = "") -> DataFrame:
    """The columns in keep (id_col if none), lang_pred string, score double in [0, 1] and bits_per_byte double of each row, each with
    the suffix; with an empty one, underscores are added until no kept column has such a name."""
    keep = keep or [id_col]
    while not suffix.strip("_") and {c + suffix for c in ("lang_pred", "score", "bits_per_byte")} & set(keep):
        suffix += "_"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m: Model = shared.value
        for whole in batches:
            for b in blocks(whole, text_col):
                column = b.column(b.schema.get_field_index(text_col))
                texts = raw_texts(column)
                costs = m.costs(texts)
                lettered = [any(map(str.isalpha, t)) for t in map(str, (x or "" for x in column.to_pylist()))]
                pred, score, rate = [], [], []
                best = costs.argmin(axis=1) if m.languages else [0] * len(texts)
                for k, (t, ok) in enumerate(zip(texts, lettered, strict=True)):
                    if not ok or not m.languages:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        rate.append(None)
                        continue
                    least = costs[k, best[k]]
                    pred.append(m.languages[best[k]])
                    score.append(float(1 / np.exp2(np.maximum(least - costs[k], -1000)).sum()))
                    rate.append(float(least / len(t)))
                arrays = [b.column(b.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], [*keep, "lang_pred" + suffix, "score" + suffix, "bits_per_byte" + suffix])

    wanted = docs.select(*dict.fromkeys([*keep, text_col]))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return wanted.mapInArrow(run, f"{kept}, `lang_pred{suffix}` string, `score{suffix}` double, `bits_per_byte{suffix}` double")


def lettered(text_col: str = "text") -> Column:
    """The text has a letter by the rule of predict(), which str.isalpha of Python decides. Null text has none."""
    has = F.pandas_udf(lambda texts: texts.map(lambda t: t is not None and any(map(str.isalpha, t))).astype(bool), "boolean")
    return has(F.col(text_col))


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """crc32 of the id as text, modulo parts, equals part. A null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % parts == part
