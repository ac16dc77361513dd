"""Benchmark decontamination by winnowing; DataFrame operations only.

Both sides are cut into words and hashed into k-grams; every window of WINDOW words keeps its smallest k-gram hash,
so a span of WINDOW words that two texts share always leaves them a common fingerprint. Documents' fingerprints are joined
with those of the benchmark; a hit is extended over the windows that chose this fingerprint, and each is held
against the benchmark's windows by SHA-256 of its words. Where the window does not change its choice, no new
fingerprint is kept.

An item of fewer than WINDOW words is one window of its own length; each such length (at most WINDOW - 1) is run by itself.

Defined results: null and empty texts have no words, and items without words match nothing. Rows that repeat
(same doc_id, same text) each get a row of the result; rows with one doc_id and different texts are apart. A null item_id's words
count as hit, but it is in no list. Empty tables give no rows, or no hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, compact, packed, stored, table

WINDOW = 10
GRAM = 5
#: Windows of the benchmark up to which they are broadcast; beyond, the fingerprints of the documents shuffle.
SMALL = 200_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _pairs(df: DataFrame, out: str, a: str, b: str, step: int, fn) -> DataFrame:
    """out[i] = fn(a[i], b[i + step]), as far as both reach."""
    n = F.greatest(F.lit(0), F.least(F.size(a), F.size(b) - step))
    return df.withColumn(out, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(step + 1), n), fn))


def _spread(df: DataFrame, source: str, length: int, fn, name: str) -> tuple[DataFrame, str]:
    """A column that holds fn over each run of `length` elements, by doubling."""
    have, span, done = {1: source}, 1, []
    while span * 2 <= length:
        df = _pairs(df, f"_{name}{span * 2}", have[span], have[span], span, fn)
        have[span * 2] = f"_{name}{span * 2}"
        span *= 2
    at, col = 0, ""
    for span in sorted(have, reverse=True):
        if length - at >= span:
            if not col:
                col = have[span]
            else:
                df = _pairs(df, f"_{name}to{at + span}", col, have[span], at, fn)
                col = f"_{name}to{at + span}"
            done.append(col)
            at += span
    return df, col


def chosen(df: DataFrame, length: int) -> DataFrame:
    """df (with an array column words) plus chosen: for each window of `length` words, its smallest k-gram hash."""
    gram = min(GRAM, length)
    df = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    names = set(df.columns)
    df, grams = _spread(df, "_h", gram, lambda a, b: F.xxhash64(a, b), "g")
    df, least = _spread(df, grams, length - gram + 1, lambda a, b: F.least(a, b), "m")
    return df.select(*[c for c in df.columns if c in names and c != "_h"], F.col(least).alias("chosen"))


def _key(start: Column, length: int, source: str = "words") -> Column:
    return F.sha2(F.concat_ws(" ", F.slice(source, start + 1, length)), 256)


def windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """len, chosen, key, items: the distinct windows of the benchmark with the ids of the items that hold them."""
    items = stored(bench.select("item_id", words(F.col("text")).alias("words")), "items").where(F.size("words") > 0)
    kept, most = F.least(F.size("words"), F.lit(window)), F.greatest(F.lit(1), F.size("words") - (window - 1))
    present = {r["n"]: r["m"] for r in items.groupBy(kept.alias("n")).agg(F.sum(most).alias("m")).collect()}  # at most `window` rows
    out = None
    for length in sorted({window, *present}):
        own = items.where(F.size("words") >= window if length == window else F.size("words") == length)
        # Not posexplode(): the filter that Spark derives from it is pushed through the chain of arrays and grows with each.
        own = chosen(own, length).select("item_id", "words", F.posexplode_outer("chosen").alias("start", "chosen")).where("start is not null")
        own = own.select("item_id", F.lit(length).alias("len"), "chosen", _key(F.col("start"), length).alias("key"))
        out = own if out is None else out.unionByName(own)
    return compact(out.groupBy("len", "chosen", "key").agg(F.collect_set("item_id").alias("items")), sum(present.values()))


def _hits(docs: DataFrame, length: int, found: DataFrame, small: bool) -> DataFrame:
    """docs (did, th, words) -> did, th, n_words, one (1 on one row of each document), start, len, items (null: no hit)."""
    reach = length - min(GRAM, length) + 1
    prints = found.select(F.col("chosen").alias("_print")).distinct().withColumn("_hit", F.lit(True))
    keys = found.select("key", "items")
    n = F.size("words").alias("n_words")
    rows = chosen(docs, length)
    one = lambda start: ((at == 0) & (F.coalesce(start, at) == at)).cast("int").alias("one")
    at = F.coalesce("pos", F.lit(0))
    if small:
        rows = rows.select("did", "th", "words", n, "chosen", F.posexplode_outer("chosen").alias("pos", "value"))
        rows = rows.where(f"pos is null or pos = 0 or value <> chosen[pos - 1] or pos % {reach} = 0")
        run = F.expr(f"filter(sequence(pos, least(pos + {reach} - 1, size(chosen) - 1)), j -> chosen[j] = value and (j = pos or j % {reach} <> 0))")
        rows = rows.join(F.broadcast(prints), F.col("value") == F.col("_print"), "left").where("_hit or pos is null or pos = 0")
        rows = rows.select("did", "th", "n_words", "pos", F.slice("words", at + 1, length + reach - 1).alias("span"), F.explode_outer(F.when(F.col("_hit"), run)).alias("start"))
        rows = rows.withColumn("_key", F.when(F.col("start").isNotNull(), _key(F.col("start") - F.col("pos"), length, "span")))
        rows = rows.join(F.broadcast(keys), F.col("_key") == F.col("key"), "left")
        return rows.select("did", "th", "n_words", one(F.col("start")), F.when(F.col("key").isNotNull(), F.col("start")).alias("start"), "items").withColumn("len", F.lit(length))
    # The spans of the fingerprints go along, not the whole texts, and are cut before rows are made of them.
    prints_of = F.expr(
        f"transform(filter(sequence(0, size(chosen) - 1), i -> size(chosen) > 0 and i >= 0 and (i = 0 or chosen[i] <> chosen[greatest(i - 1, 0)] or i % {reach} = 0)),"
        f" i -> named_struct('pos', i, 'value', chosen[i], 'near', slice(chosen, i + 1, {reach}), 'span', slice(words, i + 1, {length + reach - 1})))"
    )
    each = rows.where(F.size("words") >= length).select("did", "th", n, F.explode_outer(prints_of).alias("p")).select("did", "th", "n_words", "p.*")
    hit = each.join(prints, F.col("value") == F.col("_print"), "left_semi")
    run = F.expr(f"transform(filter(sequence(0, size(near) - 1), j -> near[j] = value and (j = 0 or (pos + j) % {reach} <> 0)), j -> pos + j)")
    hit = hit.select("did", "th", "n_words", "pos", "span", F.explode(run).alias("start")).withColumn("_key", _key(F.col("start") - F.col("pos"), length, "span"))
    hit = hit.join(keys, F.col("_key") == F.col("key")).select("did", "th", "n_words", F.lit(0).alias("one"), "start", "items")
    base = docs.select("did", "th", n, F.lit(1).alias("one"), F.lit(None).cast("int").alias("start"), F.lit(None).cast(keys.schema["items"].dataType).alias("items"))
    return base.unionByName(hit).withColumn("len", F.lit(length))


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, small: int = SMALL) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, items (array of item ids), spans (start, len of each hit window)."""
    found = stored(windows(bench, window), "windows")
    lengths = {r["len"]: r["n"] for r in found.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").alias("did"), F.sha2(text, 256).alias("th"), words(F.col("text")).alias("words"))
    all_hits = None
    for length in [window, *sorted(set(lengths) - {window})]:
        hits = _hits(base, length, found.where(F.col("len") == length), lengths.get(length, 0) <= small)
        if length != window:
            hits = hits.where("start is not null").withColumn("one", F.lit(0))
        all_hits = hits if all_hits is None else all_hits.unionByName(hits)
    spans = F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len")))
    per = all_hits.groupBy("did", "th", "n_words").agg(F.sum("one").alias("copies"), F.sort_array(spans).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.expr(
        "aggregate(spans, named_struct('e', 0L, 'n', 0L), (a, x) -> named_struct('e', greatest(a.e, cast(x.start + x.len as bigint)),"
        " 'n', a.n + greatest(0L, cast(x.start + x.len as bigint) - greatest(a.e, cast(x.start as bigint))))).n"
    )
    per = per.withColumn("_copy", F.explode(F.expr("sequence(1, cast(copies as int))")))
    return per.select(F.col("did").alias("doc_id"), F.col("th").alias("text_hash"), F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), "items", "spans")


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, bound: int = SMALL) -> DataFrame:
    """docs, with all their columns, without those in which any window of the benchmark occurs."""
    bad = contamination(docs, bench, window).where("n_hit > 0").select(F.col("doc_id").alias("_did"), F.col("text_hash").alias("_th")).distinct()
    bad = stored(compact(bad, docs.count()), "bad")
    rows = packed(docs, F.sha2(F.coalesce("text", F.lit("")), 256))
    return rows.join(broadcast_if_small(bad, bad.count(), bound), F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_key") == F.col("_th")), "left_anti").select("_row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS k FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
ls AS (SELECT DISTINCT l FROM bl),
dw AS (SELECT rid, i, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS k FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls)),
h AS (SELECT rid, i, bw.l, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.l = bw.l),
hw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT rid, i, l FROM h)) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
