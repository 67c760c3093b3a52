"""Queries of the operators on pairs, groups and texts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import components, mixture, setjoin, tokens, toxicity
from tickloom.llm.sources import source_name
from tickloom.plans.registry import Registry
from tickloom.sources.tables import table

REGISTRY = Registry()

P2_PAIRS = """
with e as (select distinct candidate_id, e, s from (
  select candidate_id, unnest(entry_indices) as e, unnest(trade_sides) as s from candidates)
  where candidate_id is not null and e is not null and s is not null),
sizes as (select candidate_id, count(*) as n from e group by 1),
shared as (select a.candidate_id as left_id, b.candidate_id as right_id, count(*) as common
  from e a join e b on a.e = b.e and a.s = b.s and a.candidate_id < b.candidate_id group by 1, 2),
p2 as (select left_id, right_id from shared join sizes x on x.candidate_id = left_id join sizes y on y.candidate_id = right_id
  where 10 * common >= 7 * (x.n + y.n - common) or (common >= 5 and 10 * common >= 9 * least(x.n, y.n)))
"""


@REGISTRY.add("p2_found", P2_PAIRS + "select left_id, right_id from p2")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.similar_pairs(setjoin.entry_tokens(table(spark, folder, "candidates")))


@REGISTRY.add("p2_link_counts", P2_PAIRS + """
select s.candidate_id, count(p.a) as links from sizes s
left join (select left_id as a from p2 union all select right_id from p2) p on p.a = s.candidate_id group by 1
""")
def p2_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.similar_counts(setjoin.entry_tokens(table(spark, folder, "candidates"))).select(F.col("id").alias("candidate_id"), "links")


P2_CLASSES = P2_PAIRS + """,
sets as (select candidate_id, list(e * 256 + s + 128 order by e * 256 + s) as tokens from e group by 1),
heads as (select candidate_id, min(candidate_id) over (partition by tokens) as representative from sets)
"""


@REGISTRY.add("p2_class_pairs", P2_CLASSES + """
select distinct least(a.representative, b.representative) as left_id, greatest(a.representative, b.representative) as right_id
from p2 join heads a on a.candidate_id = left_id join heads b on b.candidate_id = right_id where a.representative <> b.representative
""")
def p2_class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Similar sets once each, by the least id that holds them; copies are in p2_classes."""
    return setjoin.class_pairs(setjoin.entry_tokens(table(spark, folder, "candidates")))[0].select("left_id", "right_id")


@REGISTRY.add("p2_classes", P2_CLASSES + "select candidate_id, representative from heads")
def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.class_pairs(setjoin.entry_tokens(table(spark, folder, "candidates")))[1].select(F.col("id").alias("candidate_id"), "representative")


P5_SQL = """
with recursive blanks as (select chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(12288) as chars),
links as (
  select trim(candidate_id, chars) as a, trim(exact_duplicate_of, chars) as b from search_trace, blanks
  union all select trim(candidate_id, chars), trim(behavior_duplicate_of, chars) from search_trace, blanks
  union all select trim(left_id, chars), trim(right_id, chars) from pair_similarities, blanks
    where coalesce(exact_signals, false) or coalesce(exact_entries, false) or coalesce(highly_overlapping, false) or coalesce(behaviorally_similar, false)),
edges as (select a, b from links where a <> b and a <> '' and b <> '' union select b, a from links where a <> b and a <> '' and b <> ''),
reach as (select a, b from edges union select r.a, e.b from reach r join edges e on e.a = r.b)
select a as candidate_id, least(a, min(b)) as group_id from reach group by a
"""


@REGISTRY.add("p5_found", P5_SQL)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    links = components.reported_links(table(spark, folder, "search_trace"), table(spark, folder, "pair_similarities"))
    return components.linked_groups(links).select(F.col("id").alias("candidate_id"), "group_id")


@REGISTRY.add("p6_ids")
def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


@REGISTRY.add("p6_decoded", "select doc_id, coalesce(text, '') as text from documents")
def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decode(tokens.encode(table(spark, folder, "documents")))


def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    texts = toxicity.prepared(table(spark, folder, "documents"), keep=("source",))
    return toxicity.scores(texts, toxicity.train(texts, table(spark, folder, "review_labels")), keep=("source",))


@REGISTRY.add("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _toxicity(spark, folder).where("flagged and doc_id is not null").select("doc_id")


@REGISTRY.add("p8_scores")
def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _toxicity(spark, folder).select("doc_id", "score", "flagged")


@REGISTRY.add("p8_source_rates")
def p8_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _toxicity(spark, folder).groupBy(source_name().alias("source"))
        .agg(F.count("*").alias("documents"), F.sum(F.col("flagged").cast("bigint")).alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
    )


@REGISTRY.add("p7_mixture")
def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    uses, _, _ = mixture.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    return mixture.spread(uses)


@REGISTRY.add("p7_shares")
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return mixture.reached(*mixture.mixture(table(spark, folder, "documents"), targets), targets)


@REGISTRY.add("p7_tempered_mixture")
def p7_tempered_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Half as many tokens as there are, in tempered own shares with the entropy of the targets or as near as the limits
    allow. (Of all tokens, sources used once at most leave only the own shares.)"""
    uses, _, _ = mixture.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), way=partial(mixture.tempered, part=0.5))
    return mixture.spread(uses)


@REGISTRY.add("p7_temperature")
def p7_temperature(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that tempered mixing reaches, and the exponent it takes."""
    targets = table(spark, folder, "mix_targets")
    return mixture.reached(*mixture.mixture(table(spark, folder, "documents"), targets, way=partial(mixture.tempered, part=0.5)), targets)
