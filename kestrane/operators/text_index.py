"""Full-text search: postings, statistics, BM25, phrases, explanations, audit and repair.

A query needs term frequencies of its own few terms only. They are counted within each row, so scoring shuffles nothing but partial sums by
namespace; the materialised index (``postings``) is for tables that are searched again and again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import batches_bounded

K1, B = 1.2, 0.75
POSTING = ("namespace", "key", "token", "tf", "positions", "doc_len")


@dataclass(frozen=True)
class TextQuery:
    """Distinct terms, and phrases whose tokens are terms too."""

    terms: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...] = ()


def plan(query: str) -> TextQuery:
    """Quoted parts are phrases; an unbalanced quote counts as none."""
    phrases = []
    if query.count('"') % 2 == 0:
        phrases = [tuple(T.token_list(p)) for p in re.findall(r'"([^"]*)"', query)]
    return TextQuery(tuple(sorted(set(T.token_list(query)))), tuple(p for p in phrases if p))


def _by_token(tokens: Column) -> Column:
    """[(token, tf, positions)] of one row's tokens: sorted, and cut where the next token begins."""

    def cut(s: Column) -> Column:
        n = F.size(s)
        heads = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: (i == 1) | (F.get(s, i - 1)["token"] != F.get(s, i - 2)["token"]))

        def one(at: Column) -> Column:
            def run(i: Column, j: Column) -> Column:
                tf = F.coalesce(F.get(at, j + 1), n + 1) - i
                return F.struct(F.get(s, i - 1)["token"].alias("token"), tf.alias("tf"), F.transform(F.slice(s, i, tf), lambda x: x["pos"]).alias("positions"))

            return F.transform(at, run)

        return _let(heads, one)

    return _let(F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("pos")))), cut)


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(x), body)[0]


def postings(records: DataFrame, payload: str = "payload") -> DataFrame:
    """(namespace, token, key, tf, positions, doc_len): one row for each token of each record.

    Tokens are brought together within each row, so nothing but the keys is shuffled, to see which name more than one record; only the rows
    of those are merged.
    """

    def each(a: DataFrame) -> DataFrame:
        t = a.select("namespace", "key", T.tokens(F.col(payload)).alias("tokens"))
        # the outer form, for which Spark infers no filter that would work everything out once more
        return t.select("namespace", "key", F.size("tokens").alias("doc_len"), F.inline_outer(_by_token(F.col("tokens")))).filter("token is not null").select(*POSTING)

    again = records.groupBy("namespace", "key").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("namespace").alias("_ns"), F.col("key").alias("_key"))
    if again.isEmpty():
        return each(records)
    same = F.col("namespace").eqNullSafe(F.col("_ns")) & F.col("key").eqNullSafe(F.col("_key"))
    rows = each(records.join(again, same, "left_semi")).groupBy("namespace", "key", "token")
    merged = rows.agg(F.sum("tf").cast("int").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.first("doc_len").alias("doc_len"))
    return each(records.join(again, same, "left_anti")).unionByName(merged)


#: Between packed tokens. Rows whose token has it, or that lack a value, are packed as they are.
_APART = "\x01"
_PACKED = "namespace string, key string, doc_len int, tokens string, tfs string, places string, rest array<struct<token:string,tf:int,positions:array<int>,doc_len:int>>"
#: Rows that are packed at once.
PACK_ROWS = 65_536


def packed(index: DataFrame) -> DataFrame:
    """Rows of ``postings`` for a shuffle by record: adjoining rows of one record become one row, their tokens and numbers one text each.

    An index in the order of its records shrinks to a fraction; one in another order keeps its number of rows. Nothing is sorted.
    """
    batches_bounded(index.sparkSession, 10_000, 2 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= PACK_ROWS:
                yield _packed(held)
                held, size = [], 0
        if size:
            yield _packed(held)

    columns = [F.col("namespace").cast("string"), F.col("key").cast("string"), F.col("token").cast("string"), F.col("tf").cast("int"), F.col("positions").cast("array<int>"), F.col("doc_len").cast("int")]
    return index.select(*[c.alias(n) for c, n in zip(columns, POSTING, strict=True)]).mapInArrow(run, _PACKED)


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    b = pa.Table.from_batches(batches).combine_chunks()
    col = {n: b.column(n).combine_chunks() if not isinstance(c := b.column(n), pa.ChunkedArray) or c.num_chunks != 1 else c.chunk(0) for n in POSTING}
    n = b.num_rows
    flat = col["positions"].flatten()
    sizes = pc.list_value_length(col["positions"])
    plain = not any(col[c].null_count for c in ("token", "tf", "positions", "doc_len")) and not flat.null_count
    plain = plain and not pc.any(pc.match_substring(col["token"], _APART)).as_py()
    code = [pc.fill_null(pc.dictionary_encode(col[c]).indices, -1).to_numpy(zero_copy_only=False) for c in ("namespace", "key")]
    code += [col["doc_len"].to_numpy(zero_copy_only=False)] if plain else []
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in code])
    heads = np.flatnonzero(new)
    runs = pa.array(np.append(heads, n), pa.int32())
    none = pa.nulls(len(heads), pa.string())
    fields = [pa.field(c, col[c].type) for c in ("token", "tf", "positions", "doc_len")]
    kind = pa.list_(pa.struct(fields))
    texts, rest = [none, none, none], pa.nulls(len(heads), kind)
    if plain:
        joined = lambda x, ends, by: pc.binary_join(pa.ListArray.from_arrays(ends, x), by)
        ends = pa.array(np.append(0, np.cumsum(sizes.to_numpy(zero_copy_only=False))), pa.int32())
        tfs = none if pc.all(pc.equal(col["tf"], sizes)).as_py() else joined(pc.cast(col["tf"], pa.string()), runs, ",")
        texts = [joined(col["token"], runs, _APART), tfs, joined(joined(pc.cast(flat, pa.string()), ends, ","), runs, ";")]
    else:
        rest = pa.ListArray.from_arrays(runs, pa.StructArray.from_arrays([col[f.name] for f in fields], fields=fields))
    at = pa.array(heads)
    length = col["doc_len"].take(at) if plain else pa.nulls(len(heads), pa.int32())
    return pa.RecordBatch.from_arrays([col["namespace"].take(at), col["key"].take(at), length, *texts, rest], names=["namespace", "key", "doc_len", "tokens", "tfs", "places", "rest"])


def unpacked(rows: DataFrame, *beside: str) -> DataFrame:
    """What ``packed`` packed, with the columns ``beside``."""
    ints = lambda x: F.when(x == "", F.array().cast("array<int>")).otherwise(F.split(x, ",").cast("array<int>"))

    def numbered(places: Column) -> Column:
        tf = lambda tfs: F.transform(F.split("tokens", _APART), lambda t, i: _let(ints(F.get(places, i)), lambda p: F.struct(t.alias("token"), F.coalesce(F.get(tfs, i), F.size(p)).alias("tf"), p.alias("positions"), F.col("doc_len"))))
        return _let(F.split("tfs", ",").cast("array<int>"), tf)

    each = F.coalesce("rest", _let(F.split("places", ";"), numbered))
    return rows.select("namespace", "key", *beside, F.inline_outer(each)).select(*POSTING, *beside)  # outer: as in postings, and no row is empty


def doc_stats(records: DataFrame, payload: str = "payload") -> DataFrame:
    return records.select("namespace", "key", F.size(T.tokens(F.col(payload))).alias("doc_len"))


def term_stats(records: DataFrame, payload: str = "payload") -> DataFrame:
    """(namespace, token, df), without building positions: distinct tokens within each row, then one sum."""
    each = records.select("namespace", F.explode(F.array_distinct(T.tokens(F.col(payload)))).alias("token"))
    return each.groupBy("namespace", "token").agg(F.count("*").alias("df"))


def namespace_stats(records: DataFrame, payload: str = "payload") -> DataFrame:
    each = records.select("namespace", F.size(T.tokens(F.col(payload))).cast("long").alias("n"))
    return each.groupBy("namespace").agg(F.count("*").alias("doc_count"), F.sum("n").alias("total_doc_len"))


def replaced(table: DataFrame, keys: DataFrame, new: DataFrame) -> DataFrame:
    """A table of the index after changes: without the rows of ``keys`` (namespace, key), and with ``new`` ones.

    The table's rows are not made anew, and meet only the changed keys (which Spark broadcasts where it knows them to be few)."""
    on = ["namespace", "key"]
    return table.join(keys.select(*on).distinct(), on, "left_anti").select(*new.columns).unionByName(new)


def maintained(index: DataFrame, docs: DataFrame, upserts: DataFrame, deletes: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """``postings`` and ``doc_stats`` after a batch of changes, as full builds over the changed records would give them.

    ``upserts`` are records, one a (namespace, key), and win over a delete of the same key; ``deletes`` names (namespace, key). Only the
    batch's texts are tokenised, and postings meet the changed keys in packed rows."""
    keys = upserts.select("namespace", "key").unionByName(deletes.select("namespace", "key"))
    stay = packed(index).join(keys.distinct(), ["namespace", "key"], "left_anti")
    return unpacked(stay).unionByName(postings(upserts, payload)), replaced(docs, keys, doc_stats(upserts, payload))


def stats_of(docs: DataFrame) -> DataFrame:
    """``namespace_stats`` from maintained ``doc_stats``."""
    return docs.groupBy("namespace").agg(F.count("*").alias("doc_count"), F.sum(F.col("doc_len").cast("long")).alias("total_doc_len"))


def _phrase_hit(joined: Column, phrase: tuple[str, ...]) -> Column:
    """Adjacent tokens, looked for in the tokens joined by spaces."""
    return F.contains(F.concat(F.lit(" "), joined, F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


def _count(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == F.lit(term)))


def scored(records: DataFrame, query: TextQuery, keep: Column | None = None, payload: str = "payload") -> DataFrame:
    """Rows with a term of the query, with ``score`` and, for each term i, ``_tf_i, _df_i, _part_i``; besides ``doc_len, doc_count, avgdl``.

    Statistics are those of the whole namespace; ``keep`` (a metadata filter) picks rows only after that.
    """
    n = len(query.terms)
    a = records.withColumn("_tokens", T.tokens(F.col(payload)))
    a = a.withColumns({"doc_len": F.size("_tokens")} | {f"_tf_{i}": _count(F.col("_tokens"), t) for i, t in enumerate(query.terms)})
    sums = [F.count("*").alias("doc_count"), F.sum(F.col("doc_len").cast("long")).alias("_total")]
    sums += [F.sum((F.col(f"_tf_{i}") > 0).cast("long")).alias(f"_df_{i}") for i in range(n)]
    stats = a.groupBy("namespace").agg(*sums).withColumnRenamed("namespace", "_ns")
    stats = stats.withColumn("avgdl", F.when(F.col("_total") > 0, F.col("_total") / F.col("doc_count")).otherwise(1.0)).drop("_total")
    # no filter passes a row number, so the counts aren't copied into the filter and each text is split once
    some = reduce(lambda x, y: x | y, [F.col(f"_tf_{i}") > 0 for i in range(n)], F.lit(False))
    hits = a.withColumn("_row", F.monotonically_increasing_id()).filter(some & (F.col("_row") >= 0)).drop("_row")
    if query.phrases:
        joined = F.array_join("_tokens", " ")
        hits = hits.filter(reduce(lambda x, y: x & y, [_phrase_hit(joined, p) for p in query.phrases]))
    if keep is not None:
        hits = hits.filter(keep)
    hits = hits.drop("_tokens").join(stats, F.col("namespace").eqNullSafe(F.col("_ns"))).drop("_ns")

    def part(i: int) -> Column:
        tf, df, big = F.col(f"_tf_{i}").cast("double"), F.col(f"_df_{i}").cast("double"), F.col("doc_count").cast("double")
        idf = F.log(1 + (big - df + 0.5) / (df + 0.5))
        return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))

    hits = hits.withColumns({f"_part_{i}": part(i) for i in range(n)})
    return hits.withColumn("score", F.round(reduce(lambda x, y: x + y, [F.col(f"_part_{i}") for i in range(n)], F.lit(0.0)), 6))


def bm25(records: DataFrame, query: str | TextQuery, k: int, keep: Column | None = None) -> DataFrame:
    """The k best rows: score descending, then key."""
    q = plan(query) if isinstance(query, str) else query
    if not q.terms or k <= 0:
        return records.withColumn("score", F.lit(0.0)).limit(0)
    return scored(records, q, keep).orderBy(F.desc("score"), "key", "namespace").limit(k).select(*records.columns, "score")


def _followed(phrase: tuple[str, ...]):
    """Whether a phrase's later tokens stand right after a place of its first one."""

    def at(x: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.array_contains(F.element_at("_at", t), x + i) for i, t in enumerate(phrase) if i], F.lit(True))

    return at


def bm25_from_index(index: DataFrame, stats: DataFrame, terms: DataFrame, query: TextQuery, k: int) -> DataFrame:
    """The same from materialised ``postings``, ``namespace_stats`` and ``term_stats``: postings are pruned to the query's terms first."""
    hit = index.filter(F.col("token").isin(*query.terms)).join(terms.filter(F.col("token").isin(*query.terms)), ["namespace", "token"]).join(stats, "namespace")
    tf, df, big = F.col("tf").cast("double"), F.col("df").cast("double"), F.col("doc_count").cast("double")
    avgdl = F.when(F.col("total_doc_len") > 0, F.col("total_doc_len") / F.col("doc_count")).otherwise(1.0)
    part = F.log(1 + (big - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / avgdl))
    at = F.map_from_entries(F.collect_list(F.struct("token", "positions")))
    out = hit.groupBy("namespace", "key").agg(F.round(F.sum(part), 6).alias("score"), at.alias("_at"))
    for p in query.phrases:
        first = F.element_at("_at", p[0])
        out = out.filter(F.coalesce(F.exists(first, _followed(p)), F.lit(False)))
    return out.drop("_at").orderBy(F.desc("score"), "key", "namespace").limit(k)


def explained(records: DataFrame, query: str, k: int) -> DataFrame:
    """For the k best rows one row for each matched term: tf, df, doc_len, contribution; and the snippet."""
    q = plan(query)
    top = scored(records, q).orderBy(F.desc("score"), "key", "namespace").limit(k)
    each = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"_tf_{i}").alias("tf"), F.col(f"_df_{i}").alias("df"), F.round(f"_part_{i}", 6).alias("contribution")) for i, t in enumerate(q.terms)])
    out = top.select("namespace", "key", "score", "doc_len", "payload", F.inline(each)).filter("tf > 0")
    return out.withColumn("snippet", T.snippet(F.col("payload"), list(q.terms))).drop("payload")


def _met(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(namespace, key, token, x, y): a full outer join, with null keys equal. One shuffle of packed rows by record serves both sides."""
    sides = [packed(a).withColumn("_side", F.lit(i)) for i, a in enumerate((expected, actual))]
    rows = unpacked(sides[0].unionByName(sides[1]).repartition("namespace", "key"), "_side")
    own = lambda i: F.collect_list(F.when(F.col("_side") == i, F.struct("tf", "positions", "doc_len")))
    both = rows.groupBy("namespace", "key", "token").agg(own(0).alias("x"), own(1).alias("y"))
    return both.withColumn("x", F.explode_outer("x")).withColumn("y", F.explode_outer("y"))


def audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row of counts: postings missing, unexpected, and differing in tf, positions or length."""
    here = F.col("x").isNotNull() & F.col("y").isNotNull()
    return _met(expected, actual).agg(
        F.count_if(F.col("y").isNull()).alias("missing"),
        F.count_if(F.col("x").isNull()).alias("unexpected"),
        F.count_if(here & (F.col("x.tf") != F.col("y.tf"))).alias("tf_errors"),
        F.count_if(here & (F.col("x.positions") != F.col("y.positions"))).alias("position_errors"),
        F.count_if(here & (F.col("x.doc_len") != F.col("y.doc_len"))).alias("doc_len_errors"),
    )


def repaired(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The index as it should be, and how each row came about: kept, rewritten or added."""
    how = F.when(F.col("y").isNull(), "added").when(F.col("y") == F.col("x"), "kept").otherwise("rewritten")
    return _met(expected, actual).filter("x is not null").select("namespace", "key", "token", "x.*", how.alias("repair"))
