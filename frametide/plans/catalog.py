"""One query per operator, and the SQL that says the same of the same tables.

Doubles are rounded to 6 digits on both sides; every tie is broken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aligned, embedders, evaluate, index, matcher, sampling, search, voting
from ..sources import files, frames, store
from ..sources.library import Library
from ..staging import new_path, staged
from . import surrogate

K, DIM, TOLERANCE = 10, 64, 0.6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hits(spark, d, k=K):
    """Hits, searched once, and clips."""
    q = surrogate.clips(spark, d)
    return staged(search.topk(q, surrogate.library(spark, d), k, DIM), "hits"), surrogate.clip_table(q)


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


_BASE = """
fr AS (SELECT vec_id, label AS key, embedding AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings),
lib AS (SELECT vec_id AS vector_id, key, rn * 0.5 AS t, CAST(v AS DOUBLE[]) AS v FROM fr WHERE key < 7),
bl AS (SELECT f.key AS label, f.rn // 12 AS chunk, f.rn % 12 AS q_idx, f.v, o.v AS ov, count(*) OVER (PARTITION BY f.key, f.rn // 12) AS of FROM fr f JOIN fr o ON o.vec_id = (f.vec_id + 37) % (SELECT count(*) FROM embeddings)),
mx AS (SELECT label, chunk, q_idx, a, list_transform(list_zip(v, ov), lambda z: CAST(z[1] AS DOUBLE) + a * CAST(z[2] AS DOUBLE)) AS w FROM bl, (SELECT unnest([0.0::DOUBLE, 0.6, 0.78, 0.85]) AS a) WHERE of >= 6),
qf AS (SELECT printf('%d-%d-%s', label, chunk, CAST(a AS VARCHAR)) AS clip_id, q_idx, q_idx * 0.5 AS q_t, label, chunk, a, list_transform(w, lambda x: CAST(CAST(x / greatest(sqrt(list_inner_product(w, w)), 1e-12) AS FLOAT) AS DOUBLE)) AS v FROM mx),
cl AS (SELECT clip_id, count(*) AS n_frames, any_value(label) AS label, any_value(chunk) AS chunk, any_value(a) AS a FROM qf GROUP BY clip_id),
hits AS (SELECT * FROM (SELECT clip_id, q_idx, q_t, key, t AS ref_t, vector_id, score, row_number() OVER (PARTITION BY clip_id, q_idx ORDER BY score DESC, vector_id) - 1 AS rank
  FROM (SELECT clip_id, q_idx, q_t, lib.key, lib.t, vector_id, list_inner_product(qf.v, lib.v) AS score FROM qf, lib)) WHERE rank < 10)
"""
_V2 = (
    _BASE
    + """,
h AS (SELECT *, CAST(ref_t AS DOUBLE) - q_t AS off, least(greatest(score, 0), 1) AS s, round((CAST(ref_t AS DOUBLE) - q_t) * 100) / 100 AS cand FROM hits),
c AS (SELECT DISTINCT clip_id, key, cand FROM h),
pf AS (SELECT h.clip_id, h.key, c.cand, q_idx, max(s) AS s, min(struct_pack(a := -s, b := rank, o := off, t := q_t)) AS top FROM h JOIN c ON h.clip_id = c.clip_id AND h.key = c.key AND abs(off - c.cand) <= 0.6 GROUP BY h.clip_id, h.key, c.cand, q_idx),
su AS (SELECT clip_id, key, cand, round(sum(s) / any_value(n_frames), 9) AS support FROM pf JOIN cl USING (clip_id) GROUP BY clip_id, key, cand),
bf AS (SELECT clip_id, key, cand, support FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, key ORDER BY support DESC, cand) AS n FROM su) WHERE n = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY support DESC, key) AS n FROM bf),
be AS (SELECT clip_id, max(key) FILTER (n = 1) AS key, max(cand) FILTER (n = 1) AS cand, max(support) FILTER (n = 1) AS confidence, coalesce(max(support) FILTER (n = 2), 0) AS runner_up FROM rk WHERE n <= 2 GROUP BY clip_id),
br AS (SELECT *, CASE WHEN confidence > 0 THEN runner_up / confidence ELSE 1 END AS ratio FROM be),
al AS (SELECT pf.clip_id, q_idx, s, top.o AS off, top.t AS q_t FROM pf JOIN br USING (clip_id, key, cand) WHERE s > 0),
ws AS (SELECT clip_id, off, sum(s) AS w FROM al GROUP BY clip_id, off),
wr AS (SELECT clip_id, off, round(sum(w) OVER (PARTITION BY clip_id ORDER BY off), 9) AS run, round(sum(w) OVER (PARTITION BY clip_id) / 2, 9) AS half FROM ws),
wm AS (SELECT clip_id, min(off) AS offset_s FROM wr WHERE run >= half GROUP BY clip_id),
sh AS (SELECT clip_id, any_value(offset_s) AS offset_s, median(abs(off - offset_s)) AS spread, min(q_t) AS q_lo, max(q_t) AS q_hi, count(*) AS n_aligned FROM al JOIN wm USING (clip_id) GROUP BY clip_id),
v2 AS (SELECT cl.*, key, coalesce(confidence, 0) AS confidence, ratio, runner_up, offset_s, spread, q_lo, q_hi, coalesce(n_aligned, 0) AS n_aligned, coalesce(confidence >= 0.785 AND ratio <= 0.8, false) AS accepted,
  CASE WHEN key IS NULL THEN 'no_candidates' WHEN confidence >= 0.785 AND ratio <= 0.8 THEN NULL WHEN confidence < 0.785 THEN 'low_score' ELSE 'ambiguous' END AS reason
  FROM cl LEFT JOIN br USING (clip_id) LEFT JOIN sh USING (clip_id)),
ju AS (SELECT clip_id, label, a, CAST(chunk AS VARCHAR) AS film_chunk, concat('c', label, '-', chunk) AS base_id, label < 7 AS known, key, confidence, ratio, accepted, label < 7 AND coalesce(key = label, false) AS correct, abs(offset_s - 6.0 * chunk) AS err FROM v2)
"""
)
_V1 = (
    _BASE
    + """,
vo AS (SELECT clip_id, key, count(*) AS votes, round(sum(score), 9) AS score_sum, min(struct_pack(a := q_idx, b := rank)) AS first FROM hits GROUP BY clip_id, key),
wi AS (SELECT clip_id, key, vote_ratio FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY votes DESC, score_sum DESC, first) AS n, votes / sum(votes) OVER (PARTITION BY clip_id) AS vote_ratio FROM vo) WHERE n = 1),
ow AS (SELECT hits.*, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, q_idx, rank) AS pos, CAST(ref_t AS DOUBLE) - q_t AS off, floor(CAST(CAST(CAST(ref_t AS DOUBLE) - q_t AS FLOAT) AS DOUBLE) / 0.5) AS bin FROM hits JOIN wi USING (clip_id, key)),
bc AS (SELECT clip_id, 0.7 * avg(CAST(CAST(score AS FLOAT) AS DOUBLE)) + 0.3 * avg(CASE WHEN CAST(score AS FLOAT) >= CAST(0.9 AS FLOAT) THEN 1.0::DOUBLE ELSE 0 END) AS base_conf FROM ow WHERE rank = 0 GROUP BY clip_id),
hm AS (SELECT clip_id, (bin + 0.5) * 0.5 AS best_offset FROM (SELECT clip_id, bin, row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, min(pos)) AS r FROM ow GROUP BY clip_id, bin) WHERE r = 1),
ne AS (SELECT ow.*, best_offset, abs(off - best_offset) <= 0.75 AS near, count(*) OVER (PARTITION BY clip_id) AS n_hits, sum(CASE WHEN abs(off - best_offset) <= 0.75 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id) AS n_near FROM ow JOIN hm USING (clip_id)),
us AS (SELECT *, CAST(CAST(q_t + best_offset AS FLOAT) AS DOUBLE) AS t32, n_near >= greatest(5, floor(0.3 * n_hits)) AS aligned FROM ne WHERE near OR NOT n_near >= greatest(5, floor(0.3 * n_hits))),
s1 AS (SELECT clip_id, any_value(best_offset) AS offset_s, any_value(aligned) AS aligned, CASE WHEN any_value(aligned) THEN any_value(n_near) / any_value(n_hits) ELSE 1.0 END AS align_ratio, round(sum(t32 * greatest(CAST(CAST(score AS FLOAT) AS DOUBLE), 1e-6)) / sum(greatest(CAST(CAST(score AS FLOAT) AS DOUBLE), 1e-6)), 2) AS est_timestamp FROM us GROUP BY clip_id),
dw AS (SELECT clip_id, t32 AS window_start, e AS window_end FROM (SELECT clip_id, t32, e, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, total DESC, t32) AS r FROM (SELECT clip_id, t32, count(*) OVER w AS n, round(sum(score) OVER w, 9) AS total, max(t32) OVER w AS e FROM us WINDOW w AS (PARTITION BY clip_id ORDER BY t32 RANGE BETWEEN CURRENT ROW AND 6.0 FOLLOWING))) WHERE r = 1),
v1 AS (SELECT cl.clip_id, wi.key, coalesce(base_conf, 0) AS base_conf, align_ratio, aligned, vote_ratio, est_timestamp, offset_s, window_start, window_end, round(least(greatest(0.6 * coalesce(base_conf, 0) + 0.4 * align_ratio, 0), 1), 4) AS confidence FROM cl LEFT JOIN wi USING (clip_id) LEFT JOIN bc USING (clip_id) LEFT JOIN s1 USING (clip_id) LEFT JOIN dw USING (clip_id))
"""
)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


@query("SELECT vec_id, round(sqrt(list_inner_product(CAST(u AS DOUBLE[]), CAST(u AS DOUBLE[]))), 5) AS norm FROM (SELECT vec_id, list_transform(v, lambda x: CAST(x * 3 / sqrt(list_inner_product(v, v) * 9) AS FLOAT)) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))")
def l2_norm_check(spark, d):
    rows = _table(spark, d, "embeddings").withColumn("u", C.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)))
    return rows.select("vec_id", _r(C.norm(F.col("u")), 5).alias("norm"))


@query("SELECT doc_id, round(CASE WHEN n_chars / 100.0 > 0 THEN least(3.0, 40 / (n_chars / 100.0)) ELSE 3.0 END, 6) AS fps FROM documents")
def query_rate(spark, d):
    return _table(spark, d, "documents").select("doc_id", _r(C.query_rate(F.col("n_chars") / 100.0, 3.0, 40)).alias("fps"))


@query(f"WITH {_BASE} SELECT clip_id, q_idx, CAST(rank AS INT) AS rank, vector_id, key, ref_t, round(score, 6) AS score FROM hits")
def knn_topk(spark, d):
    return _hits(spark, d)[0].select("clip_id", "q_idx", "rank", "vector_id", "key", "ref_t", _r("score").alias("score"))


@query(f"WITH {_BASE} SELECT clip_id, q_idx, count(*) AS n FROM qf, (SELECT * FROM lib ORDER BY vector_id LIMIT 4) GROUP BY clip_id, q_idx")
def knn_fewer_than_k(spark, d):
    few = surrogate.library(spark, d).orderBy("vector_id").limit(4)
    return search.topk(surrogate.clips(spark, d), few, K, DIM).groupBy("clip_id", "q_idx").agg(F.count("*").alias("n"))


@query(f"WITH {_BASE} SELECT clip_id, q_idx, CAST(rank AS INT) AS rank, vector_id FROM hits")
def knn_topk_sql(spark, d):
    return search.topk_sql(surrogate.clips(spark, d), surrogate.library(spark, d), K).select("clip_id", "q_idx", "rank", "vector_id")


@query(f"WITH {_BASE} SELECT clip_id, q_idx, CAST(rank AS INT) AS rank, vector_id, key, ref_t, round(score, 6) AS score FROM hits")
def knn_topk_pruned(spark, d):
    """By an index of cells and blocks; most blocks are out of reach of a query and skipped."""
    made = search.build(surrogate.library(spark, d), DIM, block_bytes=32 * DIM * 4, cells=24)
    return search.search(surrogate.clips(spark, d), made, K).select("clip_id", "q_idx", "rank", "vector_id", "key", "ref_t", _r("score").alias("score"))


@query(f"WITH {_BASE} SELECT clip_id, q_idx, CAST(rank AS INT) AS rank, vector_id FROM hits")
def knn_topk_blocks(spark, d):
    return search.topk(surrogate.clips(spark, d), surrogate.library(spark, d), K, DIM, broadcast_bytes=0, block_bytes=200 * DIM * 4).select("clip_id", "q_idx", "rank", "vector_id")


@query(f"WITH {_BASE} SELECT clip_id, q_idx, CAST(hits.rank AS INT) AS rank, concat('video-', hits.key) AS video_id, round(ref_t - q_t, 6) AS off FROM hits")
def hit_decode(spark, d):
    lib = surrogate.library(spark, d)
    names = lib.select("key").distinct().withColumn("video_id", F.concat(F.lit("video-"), F.col("key")))
    decoded = Library(lib, names, "surrogate", DIM).decode(_hits(spark, d)[0].select("clip_id", "q_idx", "q_t", "rank", "vector_id"))
    return decoded.select("clip_id", "q_idx", "rank", "video_id", _r(F.col("ref_t") - F.col("q_t")).alias("off"))


@query(f"WITH {_V2} SELECT clip_id, q_idx, CAST(rank AS INT) AS rank, round(off, 6) AS off, round(s, 6) AS s, cand FROM h")
def offset_projection(spark, d):
    return aligned.offsets(_hits(spark, d)[0]).select("clip_id", "q_idx", "rank", _r("off").alias("off"), _r("s").alias("s"), "cand")


@query(f"WITH {_V2} SELECT * FROM c")
def v2_candidates(spark, d):
    return aligned.candidates(_hits(spark, d)[0])


@query(f"WITH {_V2} SELECT clip_id, key, cand, round(support, 6) AS support FROM su")
def v2_support(spark, d):
    hits, clips = _hits(spark, d)
    return aligned.support(hits, clips.select("clip_id", "n_frames"), TOLERANCE).select("clip_id", "key", "cand", _r("support").alias("support"))


@query(f"WITH {_V2} SELECT clip_id, key, cand, round(support, 6) AS support FROM bf")
def v2_best_fit(spark, d):
    hits, clips = _hits(spark, d)
    return aligned.best_fits(aligned.support(hits, clips.select("clip_id", "n_frames"), TOLERANCE)).select("clip_id", "key", "cand", _r("support").alias("support"))


@query(f"WITH {_V2} SELECT clip_id, key, cand, round(confidence, 6) AS confidence, round(runner_up, 6) AS runner_up, round(ratio, 6) AS ratio FROM br")
def v2_ratio(spark, d):
    hits, clips = _hits(spark, d)
    return aligned.ranking(aligned.best_fits(aligned.support(hits, clips.select("clip_id", "n_frames"), TOLERANCE))).select("clip_id", "key", "cand", *[_r(c).alias(c) for c in ("confidence", "runner_up", "ratio")])


@query(
    f"WITH {_V2} SELECT clip_id, n_frames, accepted, key AS candidate_key, round(confidence, 6) AS confidence, offset_s, round(offset_s + q_lo, 2) AS window_start, round(offset_s + q_hi, 2) AS window_end, reason, round(ratio, 6) AS ratio, round(n_aligned / n_frames, 6) AS coverage, round(spread, 6) AS offset_spread_s, n_aligned FROM v2"
)
def v2_decide(spark, d):
    hits, clips = _hits(spark, d)
    out = aligned.decide(hits, clips.select("clip_id", "n_frames"))
    return out.select("clip_id", "n_frames", "accepted", "candidate_key", _r("confidence").alias("confidence"), "offset_s", "window_start", "window_end", "reason", *[_r(c).alias(c) for c in ("ratio", "coverage", "offset_spread_s")], "n_aligned")


@query(f"WITH {_V2} SELECT clip_id, key, count(*) FILTER (s > 0) AS n FROM pf JOIN bf USING (clip_id, key, cand) GROUP BY clip_id, key")
def v2_votes(spark, d):
    hits, clips = _hits(spark, d)
    return aligned.decide(hits, clips.select("clip_id", "n_frames")).select("clip_id", F.explode("votes").alias("key", "n")).select("clip_id", "key", F.col("n").cast("long").alias("n"))


def _v2_frames(spark, d):
    hits, clips = _hits(spark, d)
    frames = aligned.per_frame(hits, TOLERANCE)
    fits = aligned.best_fits(aligned.supported(frames, clips.select("clip_id", "n_frames")))
    return aligned.best_aligned(frames, fits, aligned.ranking(fits))


@query(f"WITH {_V2} SELECT clip_id, round(offset_s, 6) AS offset_s FROM wm")
def v2_weighted_median(spark, d):
    return aligned.weighted_median(_v2_frames(spark, d), ["clip_id"], "off", "s", "offset_s").select("clip_id", _r("offset_s").alias("offset_s"))


@query(f"WITH {_V2} SELECT clip_id, round(spread, 6) AS offset_spread_s FROM v2")
def v2_spread(spark, d):
    hits, clips = _hits(spark, d)
    return aligned.decide(hits, clips.select("clip_id", "n_frames")).select("clip_id", _r("offset_spread_s").alias("offset_spread_s"))


@query(f"WITH {_V2} SELECT clip_id, round(offset_s + q_lo, 2) AS window_start, round(offset_s + q_hi, 2) AS window_end, round(n_aligned / n_frames, 6) AS coverage FROM v2 WHERE key IS NOT NULL")
def v2_window(spark, d):
    hits, clips = _hits(spark, d)
    return aligned.decide(hits, clips.select("clip_id", "n_frames")).where("candidate_key is not null").select("clip_id", "window_start", "window_end", _r("coverage").alias("coverage"))


@query(f"WITH {_V2} SELECT clip_id, round(q_t, 6) AS query_t, round(q_t + off, 6) AS ref_t, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY s DESC, q_idx) AS n FROM al) WHERE n <= 10")
def v2_evidence(spark, d):
    hits, clips = _hits(spark, d)
    each = aligned.decide(hits, clips.select("clip_id", "n_frames")).select("clip_id", F.explode("evidence").alias("e"))
    return each.select("clip_id", *[_r(f"e.{c}").alias(c) for c in ("query_t", "ref_t", "score")])


@query(f"WITH {_V1} SELECT clip_id, key, votes, round(score_sum, 6) AS score_sum FROM vo")
def v1_votes(spark, d):
    return voting.votes(_hits(spark, d)[0]).select("clip_id", "key", "votes", _r("score_sum").alias("score_sum"))


@query(f"WITH {_V1} SELECT clip_id, key, round(vote_ratio, 6) AS vote_ratio FROM wi")
def v1_winner(spark, d):
    return voting.winner(voting.votes(_hits(spark, d)[0])).select("clip_id", "key", _r("vote_ratio").alias("vote_ratio"))


@query(f"WITH {_V1} SELECT clip_id, round(base_conf, 5) AS base_conf FROM bc")
def v1_base_conf(spark, d):
    hits, _ = _hits(spark, d)
    return voting.base_confidence(voting.winner_hits(hits, voting.winner(voting.votes(hits)))).select("clip_id", _r("base_conf", 5).alias("base_conf"))


@query(f"WITH {_V1} SELECT * FROM hm")
def v1_histogram_mode(spark, d):
    hits, _ = _hits(spark, d)
    return voting.histogram_mode(voting.winner_hits(hits, voting.winner(voting.votes(hits))))


@query(f"WITH {_V1} SELECT clip_id, round(window_start, 2) AS window_start, round(window_end, 2) AS window_end FROM dw")
def v1_densest_window(spark, d):
    hits, _ = _hits(spark, d)
    own = voting.winner_hits(hits, voting.winner(voting.votes(hits)))
    return voting.densest_window(voting.inliers(own, voting.histogram_mode(own)))


@query(f"WITH {_V1} SELECT clip_id, key AS candidate_key, round(confidence, 4) AS confidence, offset_s, aligned, round(align_ratio, 6) AS align_ratio, round(vote_ratio, 6) AS vote_ratio, coalesce(confidence >= 0.83 AND vote_ratio >= 0.9, false) AS accepted FROM v1")
def v1_decide(spark, d):
    hits, clips = _hits(spark, d)
    return voting.decide(hits, clips.select("clip_id", "n_frames")).select("clip_id", "candidate_key", _r("confidence", 4).alias("confidence"), "offset_s", "aligned", *[_r(c).alias(c) for c in ("align_ratio", "vote_ratio")], "accepted")


@query(f"WITH {_V1} SELECT clip_id, count(*) AS n_used, any_value(n_hits) AS n_hits, any_value(aligned) AS aligned FROM us GROUP BY clip_id")
def v1_inliers(spark, d):
    hits, _ = _hits(spark, d)
    own = voting.winner_hits(hits, voting.winner(voting.votes(hits)))
    return voting.inliers(own, voting.histogram_mode(own)).groupBy("clip_id").agg(F.count("*").alias("n_used"), F.first("n_hits").alias("n_hits"), F.first("aligned").alias("aligned"))


@query(f"WITH {_V1} SELECT clip_id, round(confidence, 4) AS confidence, round(base_conf, 5) AS base_conf, round(align_ratio, 6) AS align_ratio FROM v1 WHERE key IS NOT NULL")
def v1_confidence(spark, d):
    hits, clips = _hits(spark, d)
    return voting.decide(hits, clips.select("clip_id", "n_frames")).where("candidate_key is not null").select("clip_id", _r("confidence", 4).alias("confidence"), _r("base_conf", 5).alias("base_conf"), _r("align_ratio").alias("align_ratio"))


@query(f"WITH {_V1} SELECT clip_id, round(est_timestamp, 2) AS est_timestamp FROM v1")
def v1_timestamp(spark, d):
    hits, clips = _hits(spark, d)
    return voting.decide(hits, clips.select("clip_id", "n_frames")).select("clip_id", _r("est_timestamp", 2).alias("est_timestamp"))


@query(f"WITH {_V1}, e1 AS (SELECT *, row_number() OVER (PARTITION BY clip_id, round(ref_t, 2) ORDER BY pos) AS n FROM ow), e2 AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY pos) AS m FROM e1 WHERE n = 1) SELECT clip_id, CAST(m - 1 AS INT) AS place, q_t AS query_t, CAST(ref_t AS DOUBLE) AS ref_t, round(score, 6) AS score FROM e2 WHERE m <= 10")
def v1_evidence(spark, d):
    hits, clips = _hits(spark, d)
    each = voting.decide(hits, clips.select("clip_id", "n_frames")).select("clip_id", F.posexplode("evidence").alias("place", "e"))
    return each.select("clip_id", "place", "e.query_t", "e.ref_t", _r("e.score").alias("score"))


def _judged(spark, d):
    hits, clips = _hits(spark, d)
    done = aligned.decide(hits, clips.select("clip_id", "n_frames"))
    specs = clips.select(F.col("clip_id").alias("query_id"), F.concat(F.lit("c"), F.col("label"), F.lit("-"), F.col("chunk")).alias("base_id"), F.col("label").cast("string").alias("film_id"), F.when(F.col("label") < surrogate.INDEXED, "library").otherwise("heldout").alias("role"), (F.col("chunk") * 6.0).alias("true_offset_s"), F.col("strength").cast("string").alias("distortion"), F.col("n_frames").alias("length_s"))
    got = done.select(F.col("clip_id").alias("query_id"), F.col("candidate_key").cast("string").alias("candidate"), "confidence", F.col("ratio").alias("feature"), "offset_s")
    return evaluate.judged(specs, got)


_MET = """count(*) FILTER (known) AS n_known, count(*) FILTER (NOT known) AS n_unknown, round(avg(CAST(correct AS INT)) FILTER (accepted), 4) AS answer_precision, round(avg(CAST(accepted AND correct AS INT)) FILTER (known), 4) AS dir,
round(avg(CAST(NOT accepted AS INT)) FILTER (known), 4) AS frr, round(avg(CAST(accepted AND NOT correct AS INT)) FILTER (known), 4) AS misid, round(avg(CAST(correct AS INT)) FILTER (known), 4) AS top1, round(avg(CAST(accepted AS INT)) FILTER (NOT known), 4) AS far,
round(quantile_cont(err, 0.5) FILTER (accepted AND correct AND known), 3) AS offset_median_s, round(quantile_cont(err, 0.9) FILTER (accepted AND correct AND known), 3) AS offset_p90_s,
round(avg(CAST(err <= 0.5 AS INT)) FILTER (accepted AND correct AND known), 4) AS offset_within_half, round(avg(CAST(err <= 1.0 AS INT)) FILTER (accepted AND correct AND known), 4) AS offset_within_1s"""


def _shipped(primary=0.785, secondary=0.8):
    return evaluate.accepted(F.lit(primary), F.lit(secondary), True)


@query(f"WITH {_V2} SELECT {_MET} FROM ju")
def open_set_metrics(spark, d):
    return evaluate.metrics(_judged(spark, d), _shipped())


@query(f"WITH {_V2} SELECT 'distortion' AS kind, CAST(a AS VARCHAR) AS slice, {_MET} FROM ju GROUP BY a UNION ALL SELECT 'film_id', CAST(label AS VARCHAR), {_MET} FROM ju GROUP BY label")
def breakdown(spark, d):
    return evaluate.breakdown(_judged(spark, d), _shipped(), ("distortion", "film_id"))


_GRID = """, gr AS (SELECT round(i * 0.005, 3) AS p, (j + 12) * 5 / 100 AS q FROM range(201) a(i), range(8) b(j)),
sw AS (SELECT p, q, coalesce(avg(CAST(ok AND correct AS INT)) FILTER (known), 0) AS dir, coalesce(avg(CAST(ok AS INT)) FILTER (NOT known), 0) AS far FROM (SELECT *, coalesce(confidence >= p AND ratio <= q, false) AND key IS NOT NULL AS ok FROM ju, gr) GROUP BY p, q)"""


@query(f"WITH {_V2}{_GRID} SELECT p AS \"primary\", q AS secondary, round(dir, 6) AS dir, round(far, 6) AS far FROM sw")
def threshold_grid(spark, d):
    return evaluate.sweep(_judged(spark, d), evaluate.threshold_grid(spark, "v2"), True).select("primary", "secondary", _r("dir").alias("dir"), _r("far").alias("far"))


@query(f"WITH {_V2}{_GRID} SELECT p AS \"primary\", q AS secondary, round(dir, 6) AS dir, round(far, 6) AS far FROM sw ORDER BY far <= 0.01 + 1e-12 DESC, CASE WHEN far <= 0.01 + 1e-12 THEN dir ELSE -far END DESC, far, p DESC, q LIMIT 1")
def threshold_pick(spark, d):
    swept = evaluate.sweep(_judged(spark, d), evaluate.threshold_grid(spark, "v2"), True)
    return evaluate.pick(swept, 0.01, True).select("primary", "secondary", _r("dir").alias("dir"), _r("far").alias("far"))


@query(f"WITH {_V2}{_GRID} SELECT p AS \"primary\", round(dir, 4) AS dir, round(far, 4) AS far FROM sw WHERE q = 0.8")
def roc(spark, d):
    return evaluate.roc(_judged(spark, d), evaluate.threshold_grid(spark, "v2"), 0.8, True)


@query(
    f"""WITH {_V2}, pb AS (SELECT base_id, sum(CAST(accepted AND correct AS INT)) AS v, count(*) AS n FROM ju WHERE known GROUP BY base_id),
u AS (SELECT base_id, v, n, rep, CAST('0x' || substr(md5(base_id || '|' || rep), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM pb, range(200) t(rep)),
w AS (SELECT *, CAST(u >= 0.36787944117144233 AS INT) + CAST(u >= 0.7357588823428847 AS INT) + CAST(u >= 0.9196986029286058 AS INT) + CAST(u >= 0.9810118431238462 AS INT) + CAST(u >= 0.9963401531726563 AS INT) + CAST(u >= 0.9994058151824183 AS INT) AS k FROM u),
m AS (SELECT rep, sum(v * k) / sum(n * k) AS mean FROM w WHERE k > 0 GROUP BY rep) SELECT round(quantile_cont(mean, 0.025), 4) AS lo, round(quantile_cont(mean, 0.975), 4) AS hi FROM m"""
)
def bootstrap_ci(spark, d):
    rows = _judged(spark, d).withColumn("acc", _shipped())
    return evaluate.bootstrap(rows, F.col("acc") & F.col("correct"), F.col("known"), evaluate.hashed_weights(rows, 200))


@query(f"""WITH {_V2} SELECT 'length_s' AS kind, CAST(n_frames AS VARCHAR) AS slice, {_MET} FROM (SELECT ju.*, cl.n_frames FROM ju JOIN cl USING (clip_id)) GROUP BY n_frames
UNION ALL SELECT 'group', concat('g', label % 2), {_MET} FROM ju WHERE NOT known GROUP BY label % 2""")
def breakdown_groups(spark, d):
    """By length, and by group of the unknown queries."""
    rows = _judged(spark, d).withColumn("group", F.concat(F.lit("g"), (F.col("film_id").cast("int") % 2).cast("string")))
    return evaluate.breakdown(rows, _shipped(), ("length_s",))


@query(f"WITH {_V2.replace(' FROM v2)', ' FROM v2 WHERE chunk % 2 = 0)')}{_GRID} SELECT p AS \"primary\", q AS secondary, round(dir, 6) AS dir, round(far, 6) AS far, far <= 0.05 + 1e-12 AS feasible FROM sw ORDER BY far <= 0.05 + 1e-12 DESC, CASE WHEN far <= 0.05 + 1e-12 THEN dir ELSE -far END DESC, far, p DESC, q LIMIT 1")
def threshold_choose(spark, d):
    """Thresholds from the val split alone: base clips of even number."""
    rows = _judged(spark, d).withColumn("split", F.when((F.col("true_offset_s") / 6).cast("int") % 2 == 0, "val").otherwise("test"))
    return evaluate.choose(rows, evaluate.threshold_grid(spark, "v2"), 0.05, True).select("primary", "secondary", _r("dir").alias("dir"), _r("far").alias("far"), "feasible")


_DRAWS = """, nb AS (SELECT base_id, row_number() OVER (ORDER BY base_id) - 1 AS j, count(*) OVER () AS n FROM (SELECT DISTINCT base_id FROM ju)),
dr AS (SELECT rep, (CAST('0x' || substr(md5('7|' || rep || '|' || j), 1, 8) AS BIGINT) * n) >> 32 AS j FROM nb, range(200) t(rep)),
mw AS (SELECT base_id, rep, count(*) AS k FROM dr JOIN nb USING (j) GROUP BY base_id, rep)"""


@query(f"""WITH {_V2}{_DRAWS}, pb AS (SELECT base_id, sum(CAST(accepted AND correct AS INT)) AS v, count(*) AS n FROM ju WHERE known GROUP BY base_id),
m AS (SELECT rep, sum(v * k) / sum(n * k) AS mean FROM pb JOIN mw USING (base_id) GROUP BY rep)
SELECT round(quantile_cont(mean, 0.025), 4) AS lo, round(quantile_cont(mean, 0.975), 4) AS hi, (SELECT CAST(max(t) - min(t) AS BIGINT) FROM (SELECT sum(k) AS t FROM mw GROUP BY rep)) AS spread_of_totals, (SELECT CAST(sum(k) / 200 AS BIGINT) FROM mw) AS n_bases FROM m""")
def bootstrap_multinomial(spark, d):
    """Interval of DIR by multinomial draws; each replicate draws as many bases as there are."""
    rows = staged(_judged(spark, d).withColumn("acc", _shipped()), "judged")
    weights = staged(evaluate.multinomial_weights(rows, 200, 7), "weights")
    totals = weights.groupBy("rep").agg(F.sum("weight").alias("t")).agg((F.max("t") - F.min("t")).alias("spread_of_totals"), F.max("t").alias("n_bases"))
    return evaluate.bootstrap(rows, F.col("acc") & F.col("correct"), F.col("known"), weights).crossJoin(totals)


@query(f"""WITH {_V2}{_DRAWS}, pb AS (SELECT base_id, sum(CAST(accepted AND correct AS INT)) AS v, sum(CAST(coalesce(confidence >= 0.7 AND ratio <= 0.95, false) AND correct AS INT)) AS x, count(*) AS n FROM ju WHERE known GROUP BY base_id),
m AS (SELECT rep, sum(x * k) / sum(n * k) - sum(v * k) / sum(n * k) AS mean FROM pb JOIN mw USING (base_id) GROUP BY rep)
SELECT (SELECT round(sum(x) / sum(n) - sum(v) / sum(n), 4) FROM pb) AS difference, round(quantile_cont(mean, 0.025), 4) AS lo, round(quantile_cont(mean, 0.975), 4) AS hi FROM m""")
def paired_difference(spark, d):
    """DIR at looser thresholds less DIR at the shipped ones, with the same draws for both."""
    rows = staged(_judged(spark, d), "judged")
    weights = staged(evaluate.multinomial_weights(rows, 200, 7), "weights")
    run = lambda acc: rows.withColumn("acc", acc)
    return evaluate.paired(run(_shipped(0.7, 0.95)), run(_shipped()), F.col("acc") & F.col("correct"), F.col("known"), weights)


@query("SELECT event_type, share, round(percentile, 6) AS percentile FROM (SELECT event_type, 0.05::DOUBLE AS share, quantile_cont(value, 0.05) AS percentile FROM events GROUP BY event_type UNION ALL SELECT event_type, 0.5::DOUBLE, quantile_cont(value, 0.5) FROM events GROUP BY event_type UNION ALL SELECT event_type, 0.99::DOUBLE, quantile_cont(value, 0.99) FROM events GROUP BY event_type)")
def percentiles_selected(spark, d):
    """By selection over bins, however few values a bin is narrowed to."""
    return evaluate.percentiles(_table(spark, d, "events"), F.col("value"), (0.05, 0.5, 0.99), ("event_type",), bins=16, left=20).select("event_type", "share", _r("percentile").alias("percentile"))


def _event_frames(spark, d):
    return _table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("frame_idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


_EV = "SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS frame_idx, epoch_us(ts) / 1e6 AS t FROM events"
_GS = f"SELECT video_id, frame_idx, t, CAST(floor((t + 1e-6) * 0.0002) AS BIGINT) AS bucket FROM ({_EV}) QUALIFY row_number() OVER (PARTITION BY video_id, bucket ORDER BY t, frame_idx) = 1"


@query(f"SELECT video_id, bucket, round(t, 3) AS t FROM ({_GS})")
def grid_sample(spark, d):
    return sampling.grid_sample(_event_frames(spark, d), 0.0002).select("video_id", "bucket", F.round("t", 3).alias("t"))


@query(f"SELECT video_id, count(*) AS n, round(max(t), 3) AS last FROM (SELECT * FROM ({_GS}) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY t, frame_idx) <= 5) GROUP BY video_id")
def max_frames(spark, d):
    return sampling.grid_sample(_event_frames(spark, d), 0.0002, 5).groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.max("t"), 3).alias("last"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE floor(value) END AS pts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, CASE WHEN pts IS NULL OR pts <= -1 THEN -1.0::DOUBLE + 1 / 30.0::DOUBLE ELSE pts END AS t FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.pts IS NULL OR e.pts <= r.t THEN r.t + 1 / 30.0::DOUBLE ELSE e.pts END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS frame_idx, round(t, 6) AS t FROM r"""
)
def pts_repair(spark, d):
    rows = _table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("frame_idx"), F.when(F.col("event_id") % 7 != 0, F.floor("value").cast("double")).alias("pts"))
    return sampling.repair_times(rows, 30.0).select("video_id", "frame_idx", F.round("t", 6).alias("t"))


@query("SELECT a.doc_id, min(b.doc_id) AS other FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.doc_id <> b.doc_id GROUP BY a.doc_id")
def dup_content(spark, d):
    """The least other id of the same content."""
    return index.content_duplicates(_table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id", "sha256")


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def file_hash(spark, d):
    return index.digests(_table(spark, d, "documents"), "text").select("doc_id", "sha256", "md5")


@query("SELECT page_id, regexp_matches(url, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AS ok, regexp_matches(concat('v', page_id), '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AS ok2 FROM pages")
def valid_id(spark, d):
    return _table(spark, d, "pages").select("page_id", C.is_video_id(F.col("url")).alias("ok"), C.is_video_id(F.concat(F.lit("v"), F.col("page_id"))).alias("ok2"))


@query(
    "SELECT page_id, CASE WHEN c = '' THEN 'video' ELSE c END AS video_id FROM (SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 128) AS c FROM pages)"
)
def sanitize_id(spark, d):
    return _table(spark, d, "pages").select("page_id", C.video_id_of(F.col("url")).alias("video_id"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def resume_antijoin(spark, d):
    docs, done = _table(spark, d, "documents").select(F.col("doc_id").alias("query_id")), _table(spark, d, "labels").select(F.col("doc_id").alias("query_id"))
    return evaluate.missing(docs, done, done.limit(0)).select(F.col("query_id").alias("doc_id"))


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang")
def progress(spark, d):
    done = _table(spark, d, "labels")
    return store.progress(_table(spark, d, "documents"), done, done.limit(0), "lang", key="doc_id").select("lang", "n", "done")


@query("SELECT 'surrogate' AS embedder, count(*) AS n, count(*) FILTER (quality = 1) AS done, count(*) FILTER (coalesce(quality, 0) <> 1 AND toxic = 1) AS failed, count(*) FILTER (coalesce(quality, 0) <> 1 AND coalesce(toxic, 0) <> 1) AS todo FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)")
def store_status(spark, d):
    """labels stand for the store: quality 1 is stored, toxic 1 failed."""
    marks = _table(spark, d, "labels").withColumnRenamed("doc_id", "query_id")
    specs = _table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.lit("surrogate").alias("embedder"))
    return store.progress(specs, marks.where("quality = 1"), marks.where("toxic = 1"), "embedder")


@query("SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM conversations")
def exclusive_prefix(spark, d):
    return store.shard_starts(_table(spark, d, "conversations"), "conv_id", "turn", F.length("text")).select("conv_id", "turn", "start")


@query("SELECT quantile_cont(value, 0.5) AS value_p50, quantile_cont(value, 0.95) AS value_p95 FROM events")
def latency(spark, d):
    return evaluate.latency(_table(spark, d, "events"), "value")


@query("SELECT b, count(*) AS n FROM (SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE CAST(floor(value / 5) AS BIGINT) + 1 END AS b FROM events) GROUP BY b")
def histogram_metrics(spark, d):
    return _table(spark, d, "events").groupBy(C.bucket(F.col("value"), 0.0, 100.0, 20).cast("long").alias("b")).agg(F.count("*").alias("n"))


@query("SELECT a.event_id, b.event_id AS next_id FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_b, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events) a JOIN events b ON a.event_b = b.event_id WHERE epoch_us(a.ts) / 1e6 + 600 > epoch_us(a.next_ts) / 1e6")
def answer_key_overlap(spark, d):
    rows = _table(spark, d, "events").select(F.col("user_id").alias("film_id"), F.col("event_id").alias("base_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ref_start_s"), F.lit(600.0).alias("ref_duration_s"))
    return evaluate.overlaps(rows).select(F.col("base_id").alias("event_id"), F.col("next_base_id").alias("next_id"))


def _library(spark, d):
    rows = surrogate.library(spark, d).withColumn("video_id", F.concat(F.lit("v"), F.col("key")))
    videos = rows.groupBy("video_id").agg(F.max("t").alias("duration_s")).select("video_id", F.lit("table").alias("source_path"), F.sha2("video_id", 256).alias("sha256"), "duration_s", F.lit(2.0).alias("sample_fps"), F.lit("1970-01-01T00:00:00+00:00").alias("indexed_at"))
    return Library.empty(spark, "surrogate", DIM), videos, rows.select("video_id", "t", "vector")


_LB = "lb AS (SELECT concat('v', label) AS video_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings WHERE label < 7), "


@query(f"WITH {_LB} x AS (SELECT video_id, count(*) AS n_vectors FROM lb GROUP BY video_id) SELECT video_id, CAST(row_number() OVER (ORDER BY video_id) - 1 AS INT) AS key, CAST(n_vectors AS INT) AS n_vectors FROM x")
def library_add(spark, d):
    lib, videos, frames = _library(spark, d)
    return lib.add(videos, frames).videos.select("video_id", "key", "n_vectors")


@query(f"WITH {_LB} y AS (SELECT CAST(label AS INT) AS key, rn * 0.5 AS t, row_number() OVER (ORDER BY label, rn) - 1 AS vector_id FROM lb) SELECT key, CAST(t AS FLOAT) AS t, vector_id FROM y")
def id_assign(spark, d):
    lib, videos, frames = _library(spark, d)
    return lib.add(videos, frames).vectors.select("key", "t", "vector_id")


@query(f"WITH {_LB} y AS (SELECT CAST(label AS INT) AS key, row_number() OVER (ORDER BY label, rn) - 1 AS vector_id FROM lb) SELECT key, vector_id FROM y WHERE key NOT IN (1, 4)")
def library_remove(spark, d):
    lib, videos, frames = _library(spark, d)
    return lib.add(videos, frames).remove(["v1", "v4"]).vectors.select("key", "vector_id")


@query(f"WITH {_LB} n AS (SELECT count(*) AS n FROM lb), y AS (SELECT CAST(label AS INT) AS key, row_number() OVER (ORDER BY label, rn) - 1 AS vector_id FROM lb) SELECT key, vector_id FROM y WHERE key <> 2 UNION ALL SELECT 7, n + rn FROM lb, n WHERE label = 2")
def library_replace(spark, d):
    lib, videos, frames = _library(spark, d)
    one = videos.where("video_id = 'v2'")
    return lib.add(videos, frames).add(one, frames.join(one.select("video_id"), "video_id", "left_semi"), replace=True).vectors.select("key", "vector_id")


@query(f"WITH {_LB} y AS (SELECT CAST(label AS INT) AS key, row_number() OVER (ORDER BY label, rn) - 1 AS vector_id FROM lb) SELECT key, vector_id FROM y WHERE key IN (2, 5)")
def orphan_vectors(spark, d):
    lib, videos, frames = _library(spark, d)
    full = lib.add(videos, frames)
    return Library(full.vectors, full.videos.where("key not in (2, 5)"), full.embedder, full.dim).orphans().select("key", "vector_id")


@query(f"WITH {_LB} x AS (SELECT video_id, label, count(*) AS n FROM lb GROUP BY ALL) SELECT 'key' AS by_what, video_id, CAST(n AS INT) AS n_vectors FROM x WHERE label = 3 UNION ALL SELECT 'id', video_id, CAST(n AS INT) FROM x WHERE video_id = 'v5' UNION ALL SELECT 'sha256', video_id, CAST(n AS INT) FROM x WHERE video_id = 'v6'")
def key_lookup(spark, d):
    lib, videos, frames = _library(spark, d)
    full = lib.add(videos, frames)
    digest = videos.where("video_id = 'v6'").first()["sha256"]
    found = {"key": full.by_key(3), "id": full.get("v5"), "sha256": full.find_by_sha256(digest)}
    parts = [rows.select(F.lit(k).alias("by_what"), "video_id", "n_vectors") for k, rows in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {_LB} x AS (SELECT count(*) AS n, max(rn) * 0.5 AS s FROM lb GROUP BY label) SELECT count(*) AS n_videos, CAST(sum(n) AS BIGINT) AS n_vectors, round(sum(s) / 3600, 6) AS hours, CAST(sum(n) * 256 AS BIGINT) AS index_bytes FROM x")
def library_totals(spark, d):
    lib, videos, frames = _library(spark, d)
    return lib.add(videos, frames).totals().select("n_videos", "n_vectors", _r("hours").alias("hours"), "index_bytes")


@query("SELECT count(*) AS n_films, count(*) FILTER (NOT regexp_matches(id, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$')) AS bad_ids, count(*) FILTER (role NOT IN ('library', 'heldout')) AS bad_roles, 0::BIGINT AS bad_archives, (SELECT count(*) FROM (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1)) AS repeated_ids, count(*) FILTER (role = 'library') AS n_library FROM (SELECT n_name AS id, CASE WHEN s_acctbal < 0 THEN 'none' WHEN s_suppkey % 3 = 0 THEN 'heldout' ELSE 'library' END AS role FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def manifest_validate(spark, d):
    """Suppliers by their nation's name as a manifest with faults."""
    met = _table(spark, d, "supplier").join(_table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    role = F.when(F.col("s_acctbal") < 0, "none").when(F.col("s_suppkey") % 3 == 0, "heldout").otherwise("library")
    return files.manifest_problems(met.select(F.col("n_name").alias("id"), role.alias("role"), F.lit("").alias("archive")))


def _pictures(spark, d):
    """The 64 numbers of each embedding as a grey picture of 8 by 8."""
    byte = lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127.5).cast("long")), 2, "0")
    rgb = F.unhex(F.array_join(F.transform("embedding", lambda x: F.concat(byte(x), byte(x), byte(x))), ""))
    return _table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("video_id"), F.lit(0.0).alias("t"), F.lit(8).alias("h"), F.lit(8).alias("w"), rgb.alias("rgb"))


_PX = "px AS (SELECT CAST(vec_id AS VARCHAR) AS video_id, unnest(range(64)) AS i, floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 127.5) AS g FROM embeddings)"


@query(f"WITH {_PX}, m AS (SELECT *, g - avg(g) OVER w AS x, 2 * sqrt(sum(g * g) OVER w - 64 * (avg(g) OVER w) ** 2) AS n FROM px WINDOW w AS (PARTITION BY video_id)) SELECT video_id, round(max(x / n) FILTER (i = 0), 4) AS first, round(max(x / n) FILTER (i = 63), 4) AS last, round(max(x / n), 4) AS most FROM m GROUP BY video_id")
def tiny16(spark, d):
    """Each pixel of 8 by 8 is four of 16 by 16."""
    made = embedders.embed_frames(_pictures(spark, d), ["tiny16"])
    at = lambda i: F.round(F.get("vector", F.lit(i)).cast("double"), 4)
    return made.select("video_id", at(0).alias("first"), at(255).alias("last"), F.round(F.array_max("vector").cast("double"), 4).alias("most"))


@query(
    f"""WITH {_PX}, a AS (SELECT k, a, sum((CASE WHEN k = 0 THEN sqrt(1.0 / 32) ELSE sqrt(2.0 / 32) END) * cos(pi() * (2 * (4 * a + r) + 1) * k / 64)) AS m FROM range(8) t(k), range(8) u(a), range(4) v(r) GROUP BY k, a),
co AS (SELECT video_id, x.k * 8 + y.k AS place, sum(x.m * y.m * g) AS c FROM px JOIN a x ON x.a = i // 8 JOIN a y ON y.a = i % 8 GROUP BY video_id, x.k, y.k),
md AS (SELECT video_id, median(c) AS md FROM co WHERE place > 0 GROUP BY video_id)
SELECT video_id, string_agg(CASE WHEN c > md THEN '1' ELSE '0' END, '' ORDER BY place) AS bits FROM co JOIN md USING (video_id) GROUP BY video_id"""
)
def phash64(spark, d):
    made = embedders.embed_frames(_pictures(spark, d), ["phash64"])
    return made.select("video_id", F.array_join(F.transform("vector", lambda x: F.when(x > 0, "1").otherwise("0")), "").alias("bits"))


@query(
    f"""WITH {_PX}, k AS (SELECT unnest(['original', 'mirror', 'compression', 'letterbox', 'speed']) AS distortion)
SELECT video_id, distortion, CAST(max(v) FILTER (i = CASE WHEN distortion = 'mirror' THEN 7 ELSE 0 END) AS BIGINT) AS first, CAST(sum(v) AS BIGINT) AS total
FROM (SELECT video_id, distortion, i, CASE WHEN distortion = 'compression' THEN floor(g / 24) * 24 + 12 ELSE g END AS v FROM px, k) GROUP BY video_id, distortion"""
)
def distortions(spark, d):
    """The kinds that draw nothing."""
    made = embedders.distort_frames(_pictures(spark, d), ["original", "mirror", "compression", "letterbox", "speed"])
    grey = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(F.hex("rgb"), i * 6 + 1, F.lit(2)), 16, 10).cast("long"))
    return made.select("video_id", "distortion", F.get(grey, F.lit(0)).alias("first"), F.aggregate(grey, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    f"""WITH {_V2} SELECT clip_id, CASE WHEN accepted THEN 'match' ELSE 'unknown' END AS status, CASE WHEN accepted THEN concat('video-', key) END AS video_id, round(confidence, 4) AS confidence, CASE WHEN accepted THEN round(offset_s, 3) END AS offset_s,
CASE WHEN accepted THEN round(offset_s + q_lo, 2) END AS window_start, CASE WHEN accepted THEN round(offset_s + q_hi, 2) END AS window_end, CASE WHEN key IS NOT NULL THEN concat('video-', key) END AS candidate, CASE WHEN key IS NOT NULL THEN round(offset_s, 3) END AS candidate_offset_s,
reason, CAST(n_frames AS INT) AS n_query_frames, round(ratio, 4) AS ratio FROM v2"""
)
def match_results(spark, d):
    hits, clips = _hits(spark, d)
    names = surrogate.library(spark, d).select("key").distinct().withColumn("video_id", F.concat(F.lit("video-"), F.col("key")))
    out = matcher.results(aligned.decide(hits, clips.select("clip_id", "n_frames")), names, "v2", "surrogate")
    return out.select(
        "clip_id", "status", "video_id", "confidence", "offset_s", F.col("ref_window.start").alias("window_start"), F.col("ref_window.end").alias("window_end"), F.col("candidate.video_id").alias("candidate"),
        F.col("candidate.offset_s").alias("candidate_offset_s"), "reason", "n_query_frames", F.col("diagnostics.ratio").alias("ratio"))


_PIXELS = " || ".join(f"lower(lpad(hex((vec_id + {j}) % 256), 2, '0'))" for j in range(12))


@query("""WITH fr AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings)
SELECT CAST(label AS VARCHAR) AS video, rn AS frame_idx, rn * 0.4::DOUBLE AS t, """ + " || ".join(f"printf('%02x', (vec_id + {j}) % 256)" for j in range(12)) + " AS rgb FROM fr WHERE rn = 0 OR floor(rn * 0.4::DOUBLE + 0.000001) > floor((rn - 1) * 0.4::DOUBLE + 0.000001)")
def frames_source(spark, d):
    """Pictures of the embeddings table, written as clips through the sink and read back by ranges, one frame a second."""
    rows = surrogate.frames(spark, d)
    made = rows.select(F.col("key").cast("string").alias("query_id"), (F.col("rn") * 0.4).alias("t"), F.lit(2).alias("h"), F.lit(2).alias("w"), F.unhex(F.expr(_PIXELS)).alias("rgb"), F.lit(None).cast("string").alias("error"))
    path = new_path(spark, "clips")
    frames.save_clips(made, path, 2.5)
    read = spark.read.format("frames").option("fps", 1).option("partition_bytes", 500).load(path)
    return read.select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("video"), "frame_idx", "t", F.lower(F.hex("rgb")).alias("rgb"))
