"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, dialogue, jpeg, katz, langid, mainregion, multiset, packing, pseudonyms, simhash, timetree, tokencounts, toxicity
from .work import table

RANKS, TOKENIZER, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def _public(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op2_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), *_public(RANKS))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *_public(TOKENIZER))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainregion.extract(table(spark, sf_dir, "pages"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counted(table(spark, sf_dir, "documents"), _public(PIECES)[0])


def op12_time_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetree.return_rates(*[table(spark, sf_dir, name) for name in ("sale_lines", "sales", "items", "vendors", "clients")])


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.audited(dialogue.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz": op1_katz,
    "op2_multiset_hash": op2_multiset_hash,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_langid": op5_langid,
    "op6_jpeg": op6_jpeg,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_main_text": op10_main_text,
    "op11_token_counts": op11_token_counts,
    "op12_time_tree": op12_time_tree,
    "op13_dialogue_repair": op13_dialogue_repair,
}

_SIDES = {"item": "item_id", "vendor": "vendor_id", "client": "client_id", "kind": "kind", "nation": "nation_id", "segment": "segment", "everything": "one"}


def _history_sql(name: str, column: str) -> str:
    """Sums of other folds' earlier lines by a column, from sums of each instant."""
    earlier = "ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    of = lambda c: f"coalesce(sum({c}) OVER (PARTITION BY v {earlier}), 0) - coalesce(sum({c}) OVER (PARTITION BY v, fold {earlier}), 0) AS {c}"
    return f"h_{name} AS (SELECT v, ts, fold, {of('n')}, {of('s')} FROM (SELECT {column} AS v, ts, fold, sum(n) AS n, sum(s) AS s FROM j GROUP BY ALL))"


def _rate_sql(name: str, prior: str) -> str:
    return f"CASE WHEN h_{name}.n < 1 THEN {prior} ELSE ((1000000 * h_{name}.s + 50 * ({prior})) // (h_{name}.n + 50))::BIGINT END"


_ALL = _rate_sql("everything", "500000")
#: crc32 of the decimal digits: each byte's eight shifts by the reflected polynomial.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"

ORACLES: dict[str, str] = {
    "op12_time_tree": f"""WITH l AS (SELECT sale_id, coalesce(item_id, -1) AS item_id, vendor_id, count(*) AS n, count(*) FILTER (flag = 'returned') AS s FROM sale_lines GROUP BY 1, 2, 3),
j AS (SELECT l.*, coalesce(h.client_id, -1) AS client_id, epoch_us(h.sold_at) AS ts, ({_CRC.replace("sale_id", "h.sale_id")}) % 5 AS fold, i.kind, v.nation_id, c.segment, 1 AS one
  FROM l JOIN sales h ON h.sale_id = l.sale_id AND h.sold_at IS NOT NULL LEFT JOIN items i ON i.item_id = l.item_id LEFT JOIN vendors v ON v.vendor_id = l.vendor_id LEFT JOIN clients c ON c.client_id = coalesce(h.client_id, -1)),
{", ".join(_history_sql(n, c) for n, c in _SIDES.items())}
SELECT j.sale_id, j.item_id, j.vendor_id, j.n::BIGINT AS n_lines, j.s::BIGINT AS n_returned, {", ".join(f"h_{n}.n::BIGINT AS {n}_n, {_rate_sql(n, _rate_sql(g, _ALL))} AS {n}_rate" for n, g in (("item", "kind"), ("vendor", "nation"), ("client", "segment")))}
FROM j {" ".join(f"JOIN h_{n} ON h_{n}.v IS NOT DISTINCT FROM j.{c} AND h_{n}.ts = j.ts AND h_{n}.fold = j.fold" for n, c in _SIDES.items())}""",
}
