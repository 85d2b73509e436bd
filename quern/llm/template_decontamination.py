"""Benchmark decontamination: template canonicalisation and slot consistency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import ragged
from quern.llm.shared import map_arrow, materialize, need, table

#: Tokens of a template window; an item that is shorter is one window of its own length, from LEAST on.
WINDOW, LEAST = 8, 3
#: A window is a template if at least this share of its tokens are words; one of more slots says too little without
#: their values and is hashed with them, so that it matches word for word only.
LITERAL_SHARE = 0.5
#: A document is contaminated by an item if this share of the item's windows match with consistent slots, or if a run
#: of so many of its tokens stands there word for word.
MIN_SHARE, RUN = 0.4, 13
#: The share of slot assignments that must be one-to-one.
SLOT_SHARE = 0.8
#: The filter that documents' windows pass before the join has 2**BITS bits, whatever the benchmark's size.
BITS = 24
WINDOWS = "key long, n_windows int, pos int, start int, stop int, hash long, size int, slots array<long>"

_UNITS = """mm cm dm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres
mg g kg ton tons tonne tonnes gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml cl dl l liter liters litre litres gallon gallons
second seconds sec s minute minutes min hour hours hr hrs h day days week weeks month months year years percent degree degrees
dollar dollars cent cents euro euros usd eur gbp yen kmh mph kb mb gb tb watt watts kw kwh volt volts joule joules newton newtons pa hz khz mhz""".split()
_NAMES = """Alice Bob Carol Dave Eve Frank Grace Henry Ivan Jack Jane John Mary James Robert Michael William David Richard Joseph Thomas Charles
Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Emily Emma Olivia Sophia Mia Ava
Liam Noah Ethan Mason Lucas Oliver Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Peter Tom Tim Sam
Anna Maria Laura Julia Clara Lucy Amy Kate Natalia Weng Betty Ken Alexis Tina Randy Jim Joe Ben Max Leo Hans Klaus Pierre Marie Juan Carlos Luis Ana""".split()

_KIND = ragged.mix(np.array([0xA1, 0xB2, 0xC3, 0xD4], np.uint64))  # word (unused), number, unit, name
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[10, 13, ord("."), ord("!"), ord("?"), ord(":"), ord(";"), ord('"')]] = True
_JOIN = np.zeros(256, bool)
_JOIN[[ord(c) for c in ".,:/-"]] = True


def _lexicon(words: list[str]) -> np.ndarray:
    return np.sort(ragged.hash_words(words).hash)


def canonical(w: ragged.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a slice: (text, kind, value hash, first byte, end byte).

    Kind 1 is a number: words with a digit, joined over one of .,:/- between them.  Kind 2 is a unit: a
    word of a fixed list right after a number.  Kind 3 is a name: a capitalised word, not in capitals
    throughout, that doesn't begin a sentence, or a given name of a fixed list.  Others are kind 0, in
    lower case.
    """
    n = w.hash.size
    if not n:
        e = np.empty(0, np.int64)
        return e, e, np.empty(0, np.uint64), e, e
    digits = np.zeros(w.raw.size + 1, np.int64)
    np.cumsum((w.raw >= 48) & (w.raw <= 57), out=digits[1:])
    number = digits[w.end] > digits[w.start]
    value = w.hash.copy()
    first = np.ones(n, bool)
    same = w.doc[1:] == w.doc[:-1]
    first[1:] = ~(same & number[1:] & number[:-1] & (w.start[1:] - w.end[:-1] == 1) & _JOIN[w.raw[np.minimum(w.end[:-1], w.raw.size - 1)]])
    head = np.flatnonzero(first)
    tail = np.append(head[1:], n) - 1
    pw, _ = ragged.powers(n + 1)
    long = tail > head
    for i, j in zip(head[long], tail[long]):
        value[i] = ragged.mix(np.sum(w.hash[i : j + 1] * pw[1 : j - i + 2], keepdims=True))[0]
    start, end, doc, number, value = w.start[head], w.end[tail], w.doc[head], number[head], value[head]
    n = head.size
    prev_same = np.concatenate([[False], doc[1:] == doc[:-1]])
    after_number = np.concatenate([[False], number[:-1]]) & prev_same
    kind = np.where(number, 1, 0)
    kind[~number & after_number & ragged.member(_UNIT_HASH, value)] = 2
    at, then = w.raw[start], w.raw[np.minimum(start + 1, w.raw.size - 1)]
    latin = (at == 0xC3) & (then >= 0x80) & (then <= 0x9E)
    upper = ((at >= 65) & (at <= 90)) | latin
    lower_at = np.where(latin, start + 2, start + 1)
    second = w.raw[np.minimum(lower_at, w.raw.size - 1)]
    lower = (lower_at < end) & (((second >= 97) & (second <= 122)) | (second >= 128))
    stops = np.zeros(w.raw.size + 1, np.int64)
    np.cumsum(_SENTENCE[w.raw], out=stops[1:])
    begins = ~prev_same
    begins[1:] |= stops[start[1:]] > stops[end[:-1]]
    titled = upper & lower & (kind == 0)
    kind[titled & (~begins | ragged.member(_NAME_HASH, value))] = 3
    return doc, kind, value, start, end


_UNIT_HASH, _NAME_HASH = _lexicon(_UNITS), _lexicon(_NAMES)


def windows_of(col: pa.Array, sizes: tuple[int, ...], whole: bool, passes=None):
    """Template windows of texts, slice by slice, as (text index, windows in the text, pos, start, stop, hash, size, slots).

    sizes: their lengths in tokens; with `whole`, WINDOW, or the text's own length where that is less.
    passes: which hashes are wanted.
    """
    for lo, hi in ragged.slices(col):
        w = ragged.words(col, lo, hi)
        doc, kind, value, start, end = canonical(w)
        token = np.where(kind == 0, value, _KIND[kind])
        n_tokens = np.bincount(doc, minlength=hi - lo)
        chars = w.chars()
        pw, _ = ragged.powers(64)
        words = np.zeros(doc.size + 1, np.int64)
        np.cumsum(kind == 0, out=words[1:])
        for size in sizes:
            m = doc.size - size + 1
            if m <= 0:
                continue
            ok = doc[:m] == doc[size - 1 :]
            if whole and size < WINDOW:
                ok &= n_tokens[doc[:m]] == size
            at = np.flatnonzero(ok)
            told = (words[size:] - words[:m])[at] >= LITERAL_SHARE * size
            h = np.zeros(at.size, np.uint64)
            for j in range(size):
                h += np.where(told, token[at + j], value[at + j]) * pw[j + 1]
            h = ragged.mix(h + np.uint64(size) + np.where(told, np.uint64(0), np.uint64(1 << 32)))
            if passes is not None:
                ok = passes(h)
                at, h, told = at[ok], h[ok], told[ok]
            if not at.size:
                continue
            first = np.searchsorted(doc, doc[at])
            count = np.bincount(doc[at], minlength=hi - lo)
            base = chars[w.text_at[doc[at]]]
            cell = at[:, None] + np.arange(size)
            slot = (kind[cell] > 0) & told[:, None]
            slots = np.split(value[cell][slot].view(np.int64), np.cumsum(slot.sum(1))[:-1])
            yield lo + doc[at], count[doc[at]], at - first, chars[start[at]] - base, chars[end[at + size - 1]] - base, h.view(np.int64), size, slots


def _windows(df: DataFrame, sizes, whole: bool, bitmap=None) -> DataFrame:
    def work(it):
        passes = None if bitmap is None else (lambda h: ragged.in_bitmap(bitmap.value, h, BITS))
        for batch, col in ragged.batches(it, "text"):
            ids = batch.column(0).cast(pa.int64())
            for doc, n, pos, start, stop, h, size, slots in windows_of(col, sizes, whole, passes):
                ints = [pa.array(x.astype(np.int32)) for x in (n, pos, start, stop)]
                offsets = np.concatenate([[0], np.cumsum([s.size for s in slots])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(slots)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), *ints, pa.array(h), pa.array(np.full(h.size, size, np.int32)), lists], names=["key", "n_windows", "pos", "start", "stop", "hash", "size", "slots"])

    return map_arrow(df.toDF("key", "text"), work, WINDOWS)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE, slot_share: float = SLOT_SHARE, run_tokens: int = RUN, text: str = "text", key: str = "doc_id", item_text: str = "text", item: str = "item_id") -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other numbers, names and units.

    Columns: doc_id, item_id, n_windows (of the item, matched), n_item_windows, share, n_slots, slot_share
    (of the slot assignments that are one-to-one), kind ('verbatim' or 'reparameterised'), longest_run (tokens in a row
    that stand there word for word), and start, stop in code points.  A document counts by `min_share` of an item's
    windows or by a run of `run_tokens`, so that a part of a long item is found as well.  Every window of every document is looked up: those that pass a fixed-size filter of
    the benchmark's windows are joined by hash, counted for each document, item and diagonal (so that
    windows of one copy are judged together), and a copy counts if its slots take values one-to-one.  The
    join is an equi-join whose sides the engine sizes itself.

    Null or empty texts and items have no windows; an item of fewer than 3 tokens can't be found; null
    keys match like others; rows that repeat a doc_id count as one document; either table may be empty;
    other columns are ignored.
    """
    spark = docs.sparkSession
    items = materialize(_windows(need(benchmark, item, item_text), tuple(range(LEAST, WINDOW + 1)), True), "template-windows")
    word = F.shiftrightunsigned("hash", 64 - BITS + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) & 63 as int))")
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    for w, b in items.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).collect():  # at most 2**(BITS - 6) rows
        bitmap[w] = np.uint64(b & 0xFFFFFFFFFFFFFFFF)
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint8))
    sizes = tuple(sorted(r[0] for r in items.select("size").distinct().collect()))  # at most WINDOW rows
    found = _windows(need(docs, key, text), sizes, False, shared)
    i, d = items.alias("i"), found.alias("d")
    pairs = d.join(i, "hash").select(
        F.col("d.key").alias("doc_id"), F.col("i.key").alias("item_id"), F.col("i.n_windows").alias("n_item_windows"), (F.col("d.pos") - F.col("i.pos")).alias("diagonal"),
        F.col("i.pos").alias("pos"), F.col("i.size").alias("size"), F.col("d.start").alias("start"), F.col("d.stop").alias("stop"), F.arrays_zip(F.col("i.slots").alias("b"), F.col("d.slots").alias("v")).alias("slots"),
    )
    same = F.when(~F.exists("slots", lambda x: x.b != x.v), F.col("pos"))
    copies = pairs.groupBy("doc_id", "item_id", "n_item_windows", "diagonal").agg(F.collect_set("pos").alias("pos"), F.array_sort(F.collect_set(same)).alias("same"), F.max("size").alias("size"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    one_to_one = F.expr("least(size(array_distinct(transform(slots, x -> x.b))), size(array_distinct(transform(slots, x -> x.v))))")
    n = F.size("slots")
    copies = copies.withColumns({"n_slots": n, "slot_share": F.when(n == 0, 1.0).otherwise(one_to_one / n), "changed": F.exists("slots", lambda x: x.b != x.v)}).where(F.col("slot_share") >= slot_share)
    begin = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def longer(state, pos):
        run = F.when(pos == state.last + 1, state.run + 1).otherwise(1)
        return F.struct(pos.alias("last"), run.alias("run"), F.greatest(state.best, run).alias("best"))

    run = F.aggregate("same", begin, longer, lambda state: F.when(state.best > 0, state.best + F.col("size") - 1).otherwise(0))
    copies = copies.withColumn("run", run)
    share = F.size(F.array_distinct(F.flatten(F.collect_list("pos"))))
    out = copies.groupBy("doc_id", "item_id", "n_item_windows").agg(share.alias("n_windows"), F.max("n_slots").alias("n_slots"), F.max("run").alias("longest_run"), F.min("slot_share").alias("slot_share"), F.min("changed").alias("changed"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    out = out.withColumn("share", F.col("n_windows") / F.col("n_item_windows")).where((F.col("share") >= min_share) | (F.col("longest_run") >= run_tokens))
    return out.select("doc_id", "item_id", "n_windows", "n_item_windows", "share", "longest_run", "n_slots", "slot_share", F.when(F.col("changed"), "reparameterised").otherwise("verbatim").alias("kind"), "start", "stop")


def op5_template_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_template_decontamination": op5_template_decontamination}
ORACLE_SQL: dict[str, str] = {}
