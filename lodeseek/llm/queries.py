"""The queries of the llm problems: name -> (session, folder of tables) -> rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.llm.leakage import find_leaks
from lodeseek.llm.lookalike import fold_column, lookalike_classes, lookalike_pairs
from lodeseek.llm.mixing import mix_sources
from lodeseek.llm.neighbours import most_similar, pairs_of
from lodeseek.llm.provenance import file_layout, not_hand_written
from lodeseek.llm.ranking import loadings, rank_together
from lodeseek.llm.salience import term_scores
from lodeseek.llm.secrets import redact, scan, secrets_in
from lodeseek.llm.splitting import split_oversized
from lodeseek.operators.vector import vector_top_k


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_ranking(spark, d).where("place = 1").select("query_id", "match_id")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every match with its scaled ranks, projection and place."""
    return rank_together(_t(spark, d, "search_matches"), "query_id", "match_id", {"similarity": 1, "score": 1})


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """search_matches with the number of lines of each match."""
    span = F.expr("try_cast(split(lines, '-')[1] as int) - try_cast(split(lines, '-')[0] as int) + 1")
    return _t(spark, d, "search_matches").select("query_id", "match_id", "similarity", "score", span.alias("span"))


_THREE = {"similarity": 1, "score": 1, "span": -1}


def p1_loadings(spark: SparkSession, d: str) -> DataFrame:
    """How much each of three scores counts: similarity, score, and the shortness of the match."""
    return loadings(_spans(spark, d), "query_id", "match_id", _THREE).select("score", "direction", F.round("loading", 6).alias("loading"), "agrees")


def p1_three(spark: SparkSession, d: str) -> DataFrame:
    """Every match ranked by these three scores."""
    return rank_together(_spans(spark, d), "query_id", "match_id", _THREE).select("query_id", "match_id", F.round("projection", 6).alias("projection"), "place")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return not_hand_written(_t(spark, d, "chunks")).select("file_path")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The same files with the reason and their layout figures."""
    return not_hand_written(_t(spark, d, "chunks"))


def p2_layout(spark: SparkSession, d: str) -> DataFrame:
    """The layout statistics of every file, hand-written or not."""
    return file_layout(_t(spark, d, "chunks")).select(F.col("path").alias("file_path"), "chars", "lines", "max_line", "digits")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where("pieces > 1").select("id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces, renumbered."""
    return split_oversized(_t(spark, d, "chunks"))


def p4_properties(spark: SparkSession, d: str) -> DataFrame:
    """For every chunk that was cut: whether no piece is too long, they leave nothing out, neighbours share 100 to 300 characters, all text is as it was, and lines are true."""
    texts = _t(spark, d, "chunks").select("id", "chunk_text", "start_line").distinct()
    p = p4_pieces(spark, d).where("pieces > 1").select("id", "chunk_index", "piece", "pieces", "begin", F.col("chunk_text").alias("text"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    next_begin = F.lead("begin").over(Window.partitionBy("id").orderBy("piece"))
    shared = F.col("begin") + F.length("text") - F.col("next")
    feeds = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    row = p.withColumn("next", next_begin).join(texts, "id")
    true_first = F.col("start_line") + feeds(F.substring(F.col("chunk_text"), F.lit(1), F.col("begin")))
    true_last = F.col("start_line") + feeds(F.substring(F.col("chunk_text"), F.lit(1), F.col("begin") + F.length("text") - 1))
    whole = F.when(F.col("next").isNull(), F.col("begin") + F.length("text") == F.length("chunk_text")).otherwise(shared.between(100, 300))
    return row.groupBy("id").agg(
        (F.max(F.length("text")) <= 2048).alias("short_enough"), (F.min("begin") == 0).alias("from_start"), F.min(whole).alias("whole_with_overlap"), F.min(F.col("text") == F.substring(F.col("chunk_text"), F.col("begin") + 1, F.length("text"))).alias("same_text"), F.min((F.col("first") == true_first) & (F.col("last") == true_last)).alias("true_lines")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(most_similar(_t(spark, d, "chunks"), 5, 0.9), 0.9)


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar chunks of every chunk, however similar."""
    return most_similar(_t(spark, d, "chunks"), 5)


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the 5 nearest of every chunk whose id is divisible by 50, by comparison with all vectors: how many there are, and whether the search found 97 % of them."""
    chunks = _t(spark, d, "chunks").select("id", "embedding").dropDuplicates(["id"])
    live = chunks.where("exists(embedding, x -> x <> 0)")
    asked = live.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = vector_top_k(live, asked, 6).where("query_id <> id")
    want = want.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("r <= 5")
    got = p5_neighbours(spark, d).select(F.col("id").alias("query_id"), F.col("neighbour").alias("id"), F.lit(1).alias("hit"))
    met = want.join(got, ["query_id", "id"], "left")
    return met.agg(F.count("*").alias("neighbours"), (F.count("hit") >= 0.97 * F.count("*")).alias("found"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms of 2 to 5 chunks that stand three times or more and that the record's converged model keeps, i.e. gives more than the collection does."""
    return term_scores(_t(spark, d, "chunks")).where("df between 2 and 5 and tf >= 3 and score > background").select("id", "term")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every chunk with its score."""
    return term_scores(_t(spark, d, "chunks")).select("id", "term", "tf", "df", "cf", F.round("score", 6).alias("score"), "rounds")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets_in(_t(spark, d, "chunks")).select("id", "line_no").distinct()


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All chunks with their secrets blotted out."""
    return redact(_t(spark, d, "chunks").select("id", "file_path", "chunk_text").distinct()).select("id", F.col("redacted").alias("chunk_text"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """For every chunk, after its secrets were blotted out: whether length and line ends are as they were, nothing but blots differs, and a second pass finds nothing more than the markers of private keys."""
    c = _t(spark, d, "chunks").select("id", "file_path", "chunk_text").distinct()
    once = scan(c, spans="first", out="clean")
    twice = scan(once, text="clean", spans="second", out="again")
    plain = lambda t: F.regexp_replace(t, "[^\\r\\n]", "")
    left = F.filter("second", lambda s: s["kind"] != "private key")
    return twice.select("id", (F.length("clean") == F.length("chunk_text")).alias("same_length"), (plain(F.col("clean")) == plain(F.col("chunk_text"))).alias("same_line_ends"), ((F.size("first") > 0) | (F.col("clean") == F.col("chunk_text"))).alias("rest_untouched"), (F.size(left) == 0).alias("none_left"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """All leaks with their alignment."""
    return find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).withColumn("score", F.round("score", 6))


def p8_runs(spark: SparkSession, d: str) -> DataFrame:
    """The leaks with 15 words in a row, or all of a shorter item, which SQL can find too."""
    return find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).where("longest_run >= least(15, item_words)").select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_report(spark, d).where("short").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Targets, capacities and actual shares of the mix."""
    return mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets")).report


def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    """The flow's plan with sizes in code points, which SQL can count."""
    r = mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets"), vocabulary=None).report
    return r.select("source", "documents", F.round("target_tokens", 3).alias("target_chars"), F.col("available_tokens").alias("available_chars"), F.col("capacity_tokens").alias("capacity_chars"), F.round("planned_tokens", 3).alias("planned_chars"), "short")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """For every target: whether no document is used too often, and whether the selection comes within one document, the longest used, of what was planned."""
    m = mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))
    most = m.selection.groupBy(F.col("source").alias("s")).agg(F.max("times").alias("most"))
    longest = m.selection.agg(F.max(F.col("tokens") / F.col("times")).alias("longest"))
    near = F.abs(F.col("actual_tokens") - F.col("planned_tokens")) <= F.col("longest") + 1
    return m.report.join(most, F.col("source") == F.col("s"), "left").crossJoin(F.broadcast(longest)).select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), near.alias("as_planned"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Which documents the mix uses, for which source and how often."""
    return mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets")).selection


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(_t(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class of like-looking texts and its number of links."""
    return lookalike_classes(_t(spark, d, "documents"))


def p10_folded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in the one form."""
    return fold_column(_t(spark, d, "documents").select("doc_id", "text"), "text", "folded").select("doc_id", F.length("folded").alias("folded_chars"), F.sha2("folded", 256).alias("folded_sha"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}
