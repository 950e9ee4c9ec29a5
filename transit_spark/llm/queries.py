"""The registered queries of this subpackage, each over a whole table, with SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.catalog.registry import Registry
from transit_spark.llm import (
    language,
    lines,
    mixing,
    partenum,
    periodic_runs,
    piece_table,
    quality,
    queries_pages,
    run_index,
    sharding,
    small_world,
    token_files,
    whitening,
)
from transit_spark.llm.common import documents, ship_code
from transit_spark.session import checkpoint_root, stage

REGISTRY = Registry()
REGISTRY.queries.update(queries_pages.REGISTRY.queries)
REGISTRY.oracles.update(queries_pages.REGISTRY.oracles)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def vocabulary(name: str) -> str:
    """Place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _quality_sql() -> str:
    def condition(rule: quality.Rule) -> str:
        measure = rule.measure.replace("/ nullif", "/ nullif")
        sides = [f"{measure} < {rule.least}"] * (rule.least is not None) + [f"{measure} > {rule.most}"] * (rule.most is not None)
        return f"coalesce({' or '.join(sides)}, false)"

    space = r"\x20\x09-\x0D"
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
split as (
    select doc_id, text, [w for w in string_split_regex(text, '[{space}]+') if w <> ''] as words,
        [l for l in string_split(text, chr(10)) if regexp_matches(l, '[^{space}]')] as lines
    from texts),
single as (select doc_id, unnest(words) as w, unnest(generate_series(1, len(words))) as i from split),
windows as (
    select doc_id, i, w || ' ' || lead(w, 1) over d || ' ' || lead(w, 2) over d || ' ' || lead(w, 3) over d || ' ' || lead(w, 4) over d as w
    from single window d as (partition by doc_id order by i)),
twice as (select doc_id, i from windows where w is not null qualify count(*) over (partition by doc_id, w) > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, generate_series(0, 4) g(k) group by doc_id),
figures as (
    select s.doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[{space}]', '', 'g'))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
        len(lines)::bigint as n_lines,
        len([w for w in words if lower(w) in ({stops})])::bigint as n_stop_words,
        len([w for w in words if suffix(w, '!!')])::bigint as n_shouts,
        len([l for l in lines if suffix(rtrim(l), '...') or suffix(rtrim(l), '…')])::bigint as n_ellipsis_lines,
        len([l for l in lines if prefix(ltrim(l), '- ') or prefix(ltrim(l), '* ') or prefix(ltrim(l), '•')])::bigint as n_bullet_lines
    from split s left join covered c on s.doc_id is not distinct from c.doc_id),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from figures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and not ({' or '.join(condition(r) for r in quality.RULES)}) as kept
from judged"""


@REGISTRY.query("op1_run_length_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that a 100-byte string met earlier covers, and the hash of what is left."""
    return run_index.repeated_strings(documents(spark, sf_dir)).drop("kept")


@REGISTRY.query("op2_partenum_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the 4-word shingle sets, and the component over links of 85 hundredths or more."""
    return partenum.near_duplicates(documents(spark, sf_dir))


@REGISTRY.query("op3_packed_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, from the files they were written to."""
    files = token_files.write_token_files(documents(spark, sf_dir), folder(spark, "token-ids"), vocabulary("word_bpe_49k.json"))
    return token_files.read_token_files(files)


@REGISTRY.query("op4_last_token_table")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to, as hashes."""
    return piece_table.encode_pieces(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@REGISTRY.query("op5_flow_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, each belonging to its one source."""
    own = F.col("taken_by")[0]
    return mixing.mix(documents(spark, sf_dir), F.array("source")).select(
        "doc_id", "size", own["source_size"].alias("source_size"), own["target"].alias("target"), "taken"
    )


@REGISTRY.query("op6_small_world_graphs")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.9 or more."""
    ship_code(spark)
    return small_world.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@REGISTRY.query("op7_quality_rules", oracle=_quality_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every text, the base rules and the verdict of the threshold table."""
    rows = quality.quality_rules(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@REGISTRY.query("op8_cross_parsing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from rows that are not held out."""
    docs = documents(spark, sf_dir)
    found = language.identify(docs, language.labelled_sample(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@REGISTRY.query("op9_fuzzy_lines")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and removed of every document, and the hash of the kept text."""
    found = lines.dedup_lines(documents(spark, sf_dir))
    size = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    return found.select(
        "doc_id",
        size.alias("n_lines_kept"),
        F.col(found.columns[-1]).alias("n_lines_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


@REGISTRY.query("op10_virtual_slots")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document by a slot map that was rebalanced to near equal bytes."""
    rows = sharding.slotted(documents(spark, sf_dir))
    loads = stage(sharding.slot_loads(rows))
    maps = folder(spark, "slot-map")
    first = sharding.save_map(sharding.first_map(spark), maps, 1)
    sharding.save_map(sharding.rebalance(first, loads), maps, 2)
    placed = sharding.shard_rows(rows, sharding.load_map(spark, maps), loads)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


@REGISTRY.query("op12_square_catching")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 24 words and three periods in every text, after the stated change of some texts."""
    found = periodic_runs.periodic_runs(documents(spark, sf_dir), rewrite=periodic_runs.planted_tail)
    best = F.col("best")
    return found.withColumn("best", F.expr("if(size(runs) > 0, runs, null)")).withColumn("best", periodic_runs.strongest("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.run_lines().cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@REGISTRY.query("op13_polarised_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector of the table."""
    ship_code(spark)
    return whitening.whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("doc_id", "vec_id")
