"""Source divergence audit: how far the sources of a language differ in the words they use, and by which words.

Tasks run DuckDB on shards. A scan counts terms for each (lang, source) in its own rows. Counts meet in shards by a hash
of lang and term, where SQL sums them and keeps frequent terms. Spark adds up the totals that smoothing needs; SQL then sums
the differences between sources over each shard's terms and ranks a shard's words, and Spark merges sums and rankings.

Sources of a language are cut into blocks, and the terms of a language into chunks: one task holds one chunk and two blocks,
however many sources, terms or documents there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlgrain.llm.common import materialize, only, slices, tidied

#: Documents of a language that a kept term needs; what smoothing adds to each count; the whole of a distribution; ranks of terms.
LEAST_DOCS, ADDED, WHOLE, RANKS = 30, 5, 1_000_000_000, 50
#: Bytes of text that a statement reads, rows of counts that a task holds before it combines them or lets them go.
SLICE, HELD = 1 << 22, 1 << 20
#: Terms of a chunk and sources of a block, on average.
CHUNK, BLOCK = 2048, 256
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")

_TERMS = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term"
_COUNTS = "lang varchar, source varchar, term varchar, n bigint, docs bigint"
COUNTS = "lang string, source string, term string, n long, docs long"


def _connect():
    import duckdb  # in tasks

    con = duckdb.connect(":memory:", config={"threads": 1})
    con.execute("set memory_limit = '640MB'")
    con.execute("set temp_directory = ''")  # what a task holds is bounded; nothing goes to a machine's disk
    con.execute("set preserve_insertion_order = false")
    return con


def _batches(con, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_table().cast(schema).to_batches(1 << 16)


def _cut(text: str) -> Iterator[str]:
    """Pieces of a long text that no term crosses."""
    at = 0
    while at < len(text):
        end = _BETWEEN.search(text, at + SLICE // 4)
        to = end.end() if end else len(text)
        yield text[at:to]
        at = to


_COUNT_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _held(con) -> int:
    return con.sql("select count(*) from counts").fetchall()[0][0]


def _combine(con) -> int:
    """Sum up equal rows of counts; how many are left."""
    con.execute("create or replace table counts as select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from counts group by all")
    return _held(con)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, lang, source) to (lang, source, term, n, docs): occurrences, and documents that hold the term."""
    con = _connect()
    con.execute(f"create table counts ({_COUNTS})")
    held = 0
    for rows in slices(batches, "text", SLICE):
        if rows.num_rows == 1 and len(text := rows.column("text")[0].as_py()) > SLICE:
            con.execute("create or replace table one (term varchar, n bigint)")
            for piece in _cut(text):
                con.execute(f"insert into one select term, count(*) from (select {_TERMS} from (select ?::varchar as text)) group by term", [piece])
            con.execute("insert into counts select ?, ?, term, sum(n)::bigint, 1 from one group by term", [rows.column("lang")[0].as_py(), rows.column("source")[0].as_py()])
        else:
            con.register("documents", pa.Table.from_batches([rows]))
            con.execute(
                f"""insert into counts with t as (select row_number() over () as id, lang, source, text from documents), w as (select id, lang, source, {_TERMS} from t),
                d as (select id, lang, source, term, count(*) as n from w group by all) select lang, source, term, sum(n)::bigint, count(*) from d group by all"""
            )
            con.unregister("documents")
        held = _held(con)
        if held > HELD and _combine(con) > HELD // 2:
            yield from _batches(con, "select * from counts", _COUNT_SCHEMA)
            con.execute("delete from counts")
    if _combine(con):
        yield from _batches(con, "select * from counts", _COUNT_SCHEMA)
    con.close()


KEPT = "lang string, term string, sources array<string>, counts array<long>"
_KEPT_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _keep(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        con.execute(f"create table counts ({_COUNTS})")
        limit, held = HELD, 0
        for batch in batches:
            con.register("more", pa.Table.from_batches([batch]))
            con.execute("insert into counts select lang, source, term, n, docs from more")
            con.unregister("more")
            held += batch.num_rows
            if held > limit:
                held = _combine(con)
                limit = max(HELD, 2 * held)
        _combine(con)
        yield from _batches(
            con,
            f"select lang, term, list(source) as sources, list(n) as counts from counts group by lang, term having sum(docs) >= {least_docs}",
            _KEPT_SCHEMA,
        )
        con.close()

    return run


_PAIRS_SQL = """with s as (select b1, b2, side, source, n from (select b1, b2, 1 as side, unnest(g1, recursive := true) from pairs union all select b1, b2, 2, unnest(g2, recursive := true) from pairs where b1 <> b2)),
v as (select any_value(v) as v from pairs),
c as (select term, unnest(sources) as source, unnest(counts) as c from terms),
p as (select s.b1, s.b2, s.side, s.source, t.term, 1 + ({whole}::hugeint * (coalesce(c.c, 0) + {added})) // (s.n + {added} * v.v) as p
  from s cross join v cross join (select term from terms) t left join c on c.term = t.term and c.source = s.source),
f as (select a.b1, a.b2, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from p a join p b on a.term = b.term and a.b1 = b.b1 and a.b2 = b.b2
  and ((a.b1 = a.b2 and a.source < b.source) or a.side < b.side) group by all)
select x.source, y.source as item, coalesce(f.value, 0) as value from s x join s y on x.b1 = y.b1 and x.b2 = y.b2 and ((x.b1 = x.b2 and x.source < y.source) or x.side < y.side)
  left join f on f.b1 = x.b1 and f.b2 = x.b2 and f.source = x.source and f.item = y.source"""

_WORDS_SQL = """with s as (select unnest(g1, recursive := true) from pairs where b1 = b2), v as (select any_value(v) as v, any_value(n_lang) as n_lang from pairs),
c as (select term, unnest(sources) as source, unnest(counts) as c, list_sum(counts) as c_lang from terms),
p as (select source, c.term as item, 1 + ({whole}::hugeint * (c.c + {added})) // (s.n + {added} * v.v) as p, 1 + ({whole}::hugeint * (c.c_lang + {added})) // (v.n_lang + {added} * v.v) as q
  from c join s using (source) cross join v where c.c > 0)
select source, item, (p - q)::bigint as value from p where p > q qualify row_number() over (partition by source order by p - q desc, item) <= {ranks}"""

FOUND = "lang string, source string, part string, item string, value long"


def _compare(terms: pa.Table, pairs: pa.Table) -> pa.Table:
    """Partial sums of each pair of sources and the best words of each source, from a chunk of a language's terms."""
    lang = pairs.column("lang")[0] if pairs.num_rows else None
    out = []
    if pairs.num_rows:
        con = _connect()
        con.register("terms", terms)
        con.register("pairs", pairs)
        fixed = {"whole": WHOLE, "added": ADDED, "ranks": RANKS}
        for part, sql in (("pair", _PAIRS_SQL), ("term", _WORDS_SQL)):
            got = con.sql(sql.format(**fixed)).to_arrow_table().select(["source", "item", "value"])
            n = got.num_rows
            out.append(pa.table([pa.array([lang.as_py()] * n, pa.string()), got.column(0).cast(pa.string()), pa.array([part] * n, pa.string()), got.column(1).cast(pa.string()), got.column(2).cast(pa.int64())], names=["lang", "source", "part", "item", "value"]))
        con.close()
    empty = pa.schema([(c, pa.int64() if c == "value" else pa.string()) for c in ("lang", "source", "part", "item", "value")]).empty_table()
    return pa.concat_tables([*out, empty])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' holds each other source of the lang with the sum of differences over
    all kept terms, part 'term' the RANKS kept terms that stand out most against the lang as a whole.

    docs: text, lang, source; other columns, whatever their names, are not read. Nulls in any of the three are ''. A lang keeps the terms
    in at least least_docs of its rows; repeated rows count each time. A source without terms, or of a lang that keeps none, has its pairs
    (value 0 without kept terms) and no terms. A source alone in its lang has no pairs. Ties go by the item's bytes. Texts of any length are read whole.
    An empty table gives an empty one.
    """
    docs = only(docs, text="string", lang="string", source="string").fillna("")
    counted = docs.mapInArrow(tidied(count_terms), COUNTS)
    kept = materialize(counted.repartition("lang", "term").mapInArrow(tidied(_keep(least_docs)), KEPT), "audit-kept")
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", "x.sources").agg(F.sum("x.counts").alias("n")).withColumnRenamed("sources", "source")
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, "n")
    groups = materialize(groups, "audit-groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_lang"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").fillna(0, "v")
    langs = materialize(
        langs.select("lang", "n_lang", "v", F.ceil(F.col("n_sources") / BLOCK).cast("int").alias("blocks"), F.greatest(F.ceil(F.col("v") / CHUNK), F.lit(1)).cast("int").alias("chunks")),
        "audit-langs",
    )
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    blocks = groups.join(langs, "lang").groupBy("lang", block.alias("b")).agg(F.collect_list(F.struct("source", "n")).alias("g"))  # about BLOCK sources each
    one, two = (blocks.select("lang", F.col("b").alias(f"b{i}"), F.col("g").alias(f"g{i}")) for i in (1, 2))
    pairs = one.join(two, "lang").where("b1 <= b2").join(langs, "lang")
    pairs = pairs.select("lang", "b1", "b2", "g1", "g2", "v", "n_lang", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    spread = langs.select("lang", "blocks", "chunks")
    terms = kept.join(spread, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"), "term", "sources", "counts", "blocks")
    # a chunk meets each pair of blocks in a task of its own; up to BLOCK sources that is one
    first = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    terms = terms.withColumn("b1", first).withColumn("b2", F.explode(F.sequence(F.col("b1"), F.col("blocks") - 1))).drop("blocks")
    keys = ["lang", "chunk", "b1", "b2"]
    found = terms.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(_compare, FOUND)
    found = materialize(found, "audit-found")
    summed = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    mirrored = summed.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    merged = mirrored.unionByName(found.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return merged.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= RANKS))


def audit_sql() -> str:
    return f"""with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select id, lang, source, {_TERMS} from d),
k as (select lang, term, count(*) as c from w group by all having count(distinct id) >= 30),
l as (select lang, count(*) as v, sum(c) as n from k group by lang),
g as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*) as c from w join k using (lang, term) group by all),
gn as (select g.lang, g.source, coalesce(sum(c.c), 0) as n from g left join c using (lang, source) group by all),
p as (select gn.lang, gn.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (gn.n + 5 * l.v) as p, 1 + (1000000000::hugeint * (k.c + 5)) // (l.n + 5 * l.v) as q
  from gn join k using (lang) join l using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join f on f.lang = a.lang and f.source = a.source and f.item = b.source union all select lang, source, 'term', term, p - q from p where c > 0 and p > q),
o as (select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, value::bigint as value, rank::int as rank from o where part = 'pair' or rank <= 50"""
