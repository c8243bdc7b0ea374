"""The queries over the patch operators, on the driver's tables, and the SQL they are held against.

Doubles are rounded to six places on both sides, after everything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import align, attention, dice, geometry, grid, matching, metrics, model, overlay, rank, resize, split, votes
from tessera.plans import views
from tessera.plans.views import TILE
from tessera.sources import patches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODELS, ENSEMBLES = ("a", "b", "c"), ("deep", "soft")
ALL_VOTES = (*MODELS, *ENSEMBLES, "hard")


def query(sql: str | None):
    """Registers a query by its function's name, with its SQL behind the views that it needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = views.with_views(" ".join(sql.split()))
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def voted(s: SparkSession, d: str) -> DataFrame:
    """Classes of each model and of the soft, hard and concatenated ensembles for every row."""
    rows = views.scores(s, d)
    p = {m: F.col(f"p_{m}") for m in (*MODELS, "deep")}
    rows = rows.withColumns({m: votes.threshold_class(c) for m, c in p.items()} | {"soft": votes.soft_vote([p[m] for m in MODELS])})
    return rows.withColumn("hard", votes.hard_vote([F.col(m) for m in MODELS]))


def encoders(s: SparkSession, d: str) -> list[DataFrame]:
    return [views.encoder(s, d, n) for n in MODELS]


def keyed(s: SparkSession, d: str) -> DataFrame:
    return views.nine(s, d).withColumn("key", align.patch_key(F.col("slide_id"), F.col("x"), F.col("y"), F.col("row_idx")))


def by_encoder(s: SparkSession, d: str) -> DataFrame:
    """Long form of scores: slide_id, row_idx, encoder, score, pred, label."""
    cols = [F.struct(F.lit(m).alias("encoder"), F.col(f"p_{m}").alias("score"), F.col(m).alias("pred")) for m in MODELS]
    return voted(s, d).select("vec_id", "slide_id", "row_idx", "label", F.explode(F.array(*cols)).alias("m")).select("vec_id", "slide_id", "row_idx", "label", "m.*")


LONG = "SELECT vec_id, slide_id, row_idx, label, 'a' AS encoder, p_a AS score, a AS pred FROM votes UNION ALL SELECT vec_id, slide_id, row_idx, label, 'b', p_b, b FROM votes UNION ALL SELECT vec_id, slide_id, row_idx, label, 'c', p_c, c FROM votes"
RATES = "SELECT slide_id, sum(label) AS pos, " + ", ".join(f"sum({m} * label) AS tp_{m}, sum({m} * label) / CAST(sum(label) AS DOUBLE) AS tpr_{m}" for m in ALL_VOTES) + " FROM votes GROUP BY slide_id HAVING sum(label) > 0"
DELTAS = "greatest(" + ", ".join(f"abs(tpr_{m} - tpr_{e})" for m in MODELS for e in ENSEMBLES) + ")"
RANKED = "slide_id, CAST(pos AS BIGINT) AS pos, " + ", ".join(f"CAST(tp_{m} AS BIGINT) AS tp_{m}" for m in ALL_VOTES) + ", " + ", ".join(f"round(tpr_{m}, 6) AS tpr_{m}" for m in ALL_VOTES)


# Sources and profiles


@query("SELECT slide_id, count(*) AS n_rows, count(label) AS n_labels, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM base GROUP BY slide_id")
def profile_source(s, d):
    return patches.profile(views.base(s, d))


@query("SELECT slide_id, row_idx, x, y, label FROM base WHERE row_idx < 5")
def scan_first_rows(s, d):
    return patches.first_rows(views.base(s, d), 5).select("slide_id", "row_idx", "x", "y", "label")


def _features_labels(s, d):
    """Labels lack the rows of two slides' ends, so that those slides' counts differ."""
    rows = views.base(s, d)
    return rows.select("slide_id", "row_idx", "vec_id"), rows.where("NOT (slide_id IN ('S2', 'S5') AND row_idx >= 40)").select("slide_id", "row_idx", "label")


@query("""SELECT slide_id, n_features, n_labels FROM (SELECT slide_id, count(*) AS n_features, count(*) FILTER (NOT (slide_id IN ('S2', 'S5') AND row_idx >= 40)) AS n_labels FROM base GROUP BY slide_id)
    WHERE n_features <> n_labels""")
def profile_count_mismatch(s, d):
    return align.count_mismatch(*_features_labels(s, d))


@query("SELECT slide_id, row_idx, vec_id, label FROM base WHERE slide_id NOT IN ('S2', 'S5')")
def scan_strict(s, d):
    return align.strict_scan(*_features_labels(s, d)).select("slide_id", "row_idx", "vec_id", "label")


@query("SELECT slide_id, row_idx, vec_id, label FROM base WHERE NOT (slide_id IN ('S2', 'S5') AND row_idx >= 40)")
def scan_truncate(s, d):
    return align.truncating_scan(*_features_labels(s, d)).select("slide_id", "row_idx", "vec_id", "label")


# Alignment and fusion

FUSED = "FROM enc_a a JOIN enc_b b USING (slide_id, row_idx) JOIN enc_c c USING (slide_id, row_idx)"
SAME = "a.label = b.label AND a.label = c.label"


@query(f"""SELECT slide_id, row_idx, a.label, len(list_concat(a.features, b.features, c.features)) AS width,
    round(list_sum(list_transform(list_concat(a.features, b.features, c.features), lambda v: CAST(v AS DOUBLE))), 6) AS total, round(CAST(b.features[1] AS DOUBLE), 6) AS at_17 {FUSED} WHERE {SAME}""")
def fuse_positional(s, d):
    rows = align.fuse(encoders(s, d), [0, 1, 2])
    return rounded(rows.select("slide_id", "row_idx", "label", F.size("features").cast("long").alias("width"), views.total("features").alias("total"), F.element_at("features", 17).cast("double").alias("at_17")))


@query(f"SELECT slide_id, row_idx, round(CAST(b.features[1] AS DOUBLE), 6) AS at_1, round(CAST(a.features[1] AS DOUBLE), 6) AS at_49 {FUSED} WHERE {SAME}")
def fuse_in_other_order(s, d):
    rows = align.fuse(encoders(s, d), [1, 2, 0])
    return rounded(rows.select("slide_id", "row_idx", F.element_at("features", 1).cast("double").alias("at_1"), F.element_at("features", 49).cast("double").alias("at_49")))


@query(f"SELECT slide_id, count(*) AS n_common, count(*) FILTER ({SAME}) AS n_kept, count(*) FILTER (NOT ({SAME})) AS n_dropped {FUSED} GROUP BY slide_id")
def fuse_dropped_report(s, d):
    return align.fuse_report(encoders(s, d))


SOME = "FROM enc_a a JOIN (SELECT * FROM enc_b WHERE NOT (slide_id IN ('S1', 'S4') AND vec_id % 13 = 0)) b USING (slide_id, row_idx) JOIN enc_c c USING (slide_id, row_idx)"


@query(f"SELECT slide_id, row_idx, a.label {SOME} WHERE slide_id NOT IN (SELECT slide_id {SOME} WHERE NOT ({SAME}))")
def fuse_strict_slide(s, d):
    a, b, c = encoders(s, d)
    b = b.where("NOT (slide_id IN ('S1', 'S4') AND vec_id % 13 = 0)")
    return align.fuse_strict_slides([a, b, c], [0, 1, 2]).select("slide_id", "row_idx", "label")


@query("SELECT slide_id, key, CAST(sum(label) AS BIGINT) AS n_positive, CAST(sum(label) >= 5 AS INTEGER) AS label FROM nine GROUP BY slide_id, key HAVING count(DISTINCT source_id) = 9")
def align_keys(s, d):
    return align.align_keys(keyed(s, d), 9).drop("parts")


@query("""SELECT slide_id, key, CAST(p.u AS INTEGER) AS source_id, label FROM (SELECT slide_id, key, unnest(list(struct_pack(u := source_id, l := label))) AS p, count(*) AS k FROM nine GROUP BY slide_id, key) t,
    LATERAL (SELECT p.l AS label) WHERE k = 9""")
def align_parts(s, d):
    return align.align_keys(keyed(s, d), 9).select("slide_id", "key", F.explode("parts").alias("p")).select("slide_id", "key", "p.source_id", "p.label")


@query("""SELECT slide_id, n_aligned, n_fewest, greatest(n_fewest - n_aligned, 0) AS n_dropped FROM
    (SELECT slide_id, min(n) AS n_fewest FROM (SELECT slide_id, source_id, count(*) AS n FROM nine GROUP BY ALL) GROUP BY slide_id) JOIN
    (SELECT slide_id, count(*) AS n_aligned FROM (SELECT slide_id, key FROM nine GROUP BY ALL HAVING count(*) = 9) GROUP BY slide_id) USING (slide_id)""")
def align_dropped(s, d):
    return align.align_report(keyed(s, d), 9)


@query("SELECT slide_id FROM enc_a INTERSECT SELECT slide_id FROM enc_b WHERE slide_id <> 'S3' INTERSECT SELECT slide_id FROM enc_c WHERE slide_id <> 'S7'")
def common_slides(s, d):
    a, b, c = encoders(s, d)
    return align.common_slides([a, b.where("slide_id <> 'S3'"), c.where("slide_id <> 'S7'")])


@query("SELECT slide_id, row_idx FROM enc_a WHERE slide_id NOT IN ('S3', 'S7')")
def missing_in_any(s, d):
    a, b, c = encoders(s, d)
    return align.only_in_all(a, [b.where("slide_id <> 'S3'"), c.where("slide_id <> 'S7'")]).select("slide_id", "row_idx")


@query("SELECT slide_id, bool_and(coalesce(a.x = b.x AND a.y = b.y, false)) AS same FROM enc_a a FULL JOIN (SELECT slide_id, row_idx, x + CASE WHEN slide_id = 'S1' THEN 1 ELSE 0 END AS x, y FROM enc_a WHERE NOT (slide_id = 'S2' AND row_idx = 3)) b USING (slide_id, row_idx) GROUP BY slide_id")
def coords_equal_guard(s, d):
    a = views.encoder(s, d, "a")
    b = a.where("NOT (slide_id = 'S2' AND row_idx = 3)").withColumn("x", F.expr("x + if(slide_id = 'S1', 1, 0)"))
    return align.same_coordinates(a, b)


@query("SELECT slide_id, [a, b, c] AS counts, a = b AND b = c AS equal FROM (SELECT slide_id, count(*) FILTER (vec_id % 17 <> 1) AS a, count(*) FILTER (vec_id % 17 <> 2) AS b, count(*) FILTER (vec_id % 17 <> 3 AND slide_id <> 'S3') AS c FROM base GROUP BY slide_id)".replace("[a, b, c]", "a || ',' || b || ',' || c"))
def dimension_check(s, d):
    a, b, c = encoders(s, d)
    return align.row_counts([a, b, c.where("slide_id <> 'S3'")]).select("slide_id", F.array_join("counts", ",").alias("counts"), "equal")


@query("SELECT vec_id, mark FROM (SELECT vec_id, CASE WHEN vec_id % 5 < 2 THEN CAST(vec_id % 5 AS DOUBLE) WHEN vec_id % 5 = 2 THEN NULL WHEN vec_id % 5 = 3 THEN -1 ELSE CAST('nan' AS DOUBLE) END AS mark FROM embeddings) WHERE mark IN (0, 1)")
def valid_labels(s, d):
    rows = s.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "CASE WHEN vec_id % 5 < 2 THEN CAST(vec_id % 5 AS DOUBLE) WHEN vec_id % 5 = 2 THEN NULL WHEN vec_id % 5 = 3 THEN -1D ELSE CAST('NaN' AS DOUBLE) END AS mark")
    return metrics.valid_labels(rows, "mark")


# Counts, weights and splits


@query("SELECT slide_id, label, count(*) AS n FROM base GROUP BY ALL")
def class_counts(s, d):
    return metrics.class_counts(views.base(s, d), ["slide_id"])


@query("SELECT label, count(*) AS n, round(1 / CAST(count(*) AS DOUBLE), 6) AS weight FROM base GROUP BY label")
def inverse_weights(s, d):
    return rounded(metrics.inverse_weights(views.base(s, d)))


@query("SELECT label, n, round(sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE), 6) AS weight FROM (SELECT label, count(*) AS n FROM base GROUP BY label)")
def balanced_weights(s, d):
    return rounded(metrics.balanced_weights(views.base(s, d)))


ORDER = "row_number() OVER ({} ORDER BY md5('42|' || vec_id), vec_id)"


@query(f"SELECT vec_id, CASE WHEN r <= floor(0.2::DOUBLE * n) THEN 'validation' ELSE 'train' END AS split FROM (SELECT vec_id, {ORDER.format('')} AS r, count(*) OVER () AS n FROM base)")
def split_random(s, d):
    return split.two_way(views.base(s, d), F.col("vec_id")).select("vec_id", "split")


@query(f"SELECT vec_id, CASE WHEN r <= ceil(0.15::DOUBLE * n) THEN 'validation' ELSE 'train' END AS split FROM (SELECT vec_id, {ORDER.format('')} AS r, count(*) OVER () AS n FROM base)")
def split_ceil(s, d):
    return split.two_way(views.base(s, d), F.col("vec_id"), 0.15, up=True).select("vec_id", "split")


THREE = "CASE WHEN r <= floor(0.8::DOUBLE * n) THEN 'train' WHEN r <= floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split"


@query(f"SELECT vec_id, {THREE} FROM (SELECT vec_id, {ORDER.format('')} AS r, count(*) OVER () AS n FROM base)")
def split_shared(s, d):
    return split.three_way(views.base(s, d), F.col("vec_id")).select("vec_id", "split")


@query(f"SELECT vec_id, label, {THREE} FROM (SELECT vec_id, label, {ORDER.format('PARTITION BY label')} AS r, count(*) OVER (PARTITION BY label) AS n FROM base)")
def split_stratified(s, d):
    return split.three_way(views.base(s, d), F.col("vec_id"), ["label"]).select("vec_id", "label", "split")


# Scores, votes and metrics


@query("SELECT vec_id, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, round(p_c, 6) AS p_c, round(p_deep, 6) AS p_deep FROM scores")
def score_linear(s, d):
    return rounded(views.scores(s, d).select("vec_id", "p_a", "p_b", "p_c", "p_deep"))


@query("SELECT vec_id, soft FROM votes")
def vote_soft3(s, d):
    return voted(s, d).select("vec_id", "soft")


@query("SELECT vec_id, hard FROM votes")
def vote_hard3(s, d):
    return voted(s, d).select("vec_id", "hard")


@query("SELECT vec_id, CAST((l1 > l0) AS INTEGER) AS argmax, CAST(round(1 / (1 + exp(l0 - l1)), 6) AS DOUBLE) AS p1 FROM (SELECT vec_id, CAST(e[1] AS DOUBLE) AS l0, CASE WHEN vec_id % 7 = 0 THEN CAST(e[1] AS DOUBLE) ELSE CAST(e[2] AS DOUBLE) END AS l1 FROM base)")
def argmax_and_softmax(s, d):
    rows = views.base(s, d).selectExpr("vec_id", "CAST(e[0] AS DOUBLE) AS l0", "if(vec_id % 7 = 0, CAST(e[0] AS DOUBLE), CAST(e[1] AS DOUBLE)) AS l1")
    return rounded(rows.select("vec_id", votes.argmax_class(F.col("l0"), F.col("l1")).alias("argmax"), votes.softmax_positive(F.col("l0"), F.col("l1")).alias("p1")))


@query("SELECT vec_id, CAST(avg(1 / (1 + exp(-4 * CAST(e[7 * k + 1] AS DOUBLE)))) >= 0.5 AS INTEGER) AS vote FROM base, (SELECT range AS k FROM range(9)) GROUP BY vec_id")
def vote_soft_n(s, d):
    p = [1 / (1 + F.exp(-4 * F.element_at("e", 7 * k + 1).cast("double"))) for k in range(9)]
    return views.base(s, d).select("vec_id", votes.soft_vote(p).alias("vote"))


@query("""SELECT vec_id, CAST(sum(CAST(1 / (1 + exp(-4 * CAST(e[7 * k + 1] AS DOUBLE))) >= 0.5 AS INTEGER)) >= 5 AS INTEGER) AS vote, round(avg(1 / (1 + exp(-4 * CAST(e[7 * k + 1] AS DOUBLE)))), 6) AS mean_p
    FROM base, (SELECT range AS k FROM range(9)) GROUP BY vec_id""")
def vote_hard_n(s, d):
    p = [1 / (1 + F.exp(-4 * F.element_at("e", 7 * k + 1).cast("double"))) for k in range(9)]
    rows = views.base(s, d)
    return rounded(rows.select("vec_id", votes.hard_vote([votes.threshold_class(x) for x in p]).alias("vote"), (sum(p[1:], p[0]) / 9).alias("mean_p")))


COUNTS = "count(*) FILTER (pred = 0 AND label = 0) AS tn, count(*) FILTER (pred = 1 AND label = 0) AS fp, count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) FILTER (pred = 1 AND label = 1) AS tp"
METRICS = """round((tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 6) AS accuracy, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS sensitivity,
    round(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 6) AS specificity, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1"""


@query(f"SELECT encoder, {COUNTS} FROM ({LONG}) GROUP BY encoder")
def confusion(s, d):
    return metrics.confusion(by_encoder(s, d), ["encoder"])


@query(f"SELECT *, {METRICS} FROM (SELECT encoder, {COUNTS} FROM ({LONG}) GROUP BY encoder)")
def metrics_overall(s, d):
    return rounded(metrics.metrics(by_encoder(s, d), ["encoder"]))


@query(f"SELECT *, {METRICS} FROM (SELECT encoder, slide_id, {COUNTS} FROM ({LONG}) GROUP BY encoder, slide_id)")
def metrics_by_model_slide(s, d):
    return rounded(metrics.metrics(by_encoder(s, d), ["encoder", "slide_id"]))


@query("SELECT *, " + METRICS + " FROM (SELECT lang, source, " + COUNTS + " FROM (SELECT lang, source, quality AS pred, toxic AS label FROM labels JOIN documents USING (doc_id)) GROUP BY lang, source)")
def metrics_of_raters(s, d):
    rows = s.read.parquet(f"{d}/labels.parquet").join(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source"), "doc_id")
    return rounded(metrics.metrics(rows.withColumnRenamed("quality", "pred").withColumnRenamed("toxic", "label"), ["lang", "source"]))


@query(f"""SELECT encoder, round(CAST(sum(pos * (before + neg / 2)) AS DOUBLE) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM
    (SELECT *, coalesce(sum(neg) OVER (PARTITION BY encoder ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
    (SELECT encoder, score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM ({LONG}) GROUP BY encoder, score)) GROUP BY encoder""")
def roc_auc(s, d):
    return rounded(metrics.roc_auc(by_encoder(s, d), ["encoder"]))


@query("""SELECT round(CAST(sum(pos * (before + neg / 2)) AS DOUBLE) / nullif(sum(pos) * sum(neg), 0), 6) AS auc, kind FROM
    (SELECT *, coalesce(sum(neg) OVER (PARTITION BY kind ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
    (SELECT event_type AS kind, value AS score, CAST(sum(CAST(user_id % 3 = 0 AS INTEGER)) AS DOUBLE) AS pos, CAST(sum(CAST(user_id % 3 <> 0 AS INTEGER)) AS DOUBLE) AS neg FROM events GROUP BY event_type, value)) GROUP BY kind""")
def roc_auc_events(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").selectExpr("event_type AS kind", "value AS score", "CAST(user_id % 3 = 0 AS INT) AS label")
    return rounded(metrics.roc_auc(rows, ["kind"]))


PER_CLASS = f"""SELECT encoder, entry, coalesce(hit / nullif(CAST(hit + over AS DOUBLE), 0), 0) AS precision, coalesce(hit / nullif(CAST(hit + missed AS DOUBLE), 0), 0) AS recall,
    coalesce(2 * hit / nullif(CAST(2 * hit + over + missed AS DOUBLE), 0), 0) AS f1, hit + missed AS support FROM
    (SELECT encoder, '0' AS entry, tn AS hit, fn AS over, fp AS missed FROM (SELECT encoder, {COUNTS} FROM ({LONG}) GROUP BY encoder) UNION ALL
    SELECT encoder, '1', tp, fp, fn FROM (SELECT encoder, {COUNTS} FROM ({LONG}) GROUP BY encoder))"""


@query(f"""SELECT encoder, entry, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (SELECT * FROM ({PER_CLASS}) UNION ALL
    SELECT encoder, 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM ({PER_CLASS}) GROUP BY encoder UNION ALL
    SELECT encoder, 'weighted', CAST(sum(precision * support) / sum(support) AS DOUBLE), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM ({PER_CLASS}) GROUP BY encoder)""")
def class_report(s, d):
    return rounded(metrics.class_report(by_encoder(s, d), ["encoder"]))


@query("SELECT epoch, acc, round(loss, 6) AS loss, n FROM log ORDER BY acc DESC, epoch LIMIT 1")
def best_epoch(s, d):
    return rounded(metrics.best_epoch(views.epoch_log(s, d)).select("epoch", "acc", "loss", "n"))


@query("SELECT epoch // 4 AS epoch, round(avg(loss), 6) AS loss_by_batch, round(sum(loss * n) / CAST(sum(n) AS DOUBLE), 6) AS loss_by_sample FROM log GROUP BY epoch // 4")
def mean_loss(s, d):
    return rounded(metrics.mean_loss(views.epoch_log(s, d).withColumn("epoch", F.expr("epoch div 4"))))


@query("SELECT encoder, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(coalesce(stddev_samp(score), 0), 6) AS std, count(*) AS n FROM (" + LONG + ") GROUP BY encoder")
def score_summary(s, d):
    return rounded(metrics.score_summary(by_encoder(s, d), "score", ["encoder"]))


# Ranking


def slide_table(s: SparkSession, d: str) -> DataFrame:
    return rank.slide_table(voted(s, d), MODELS, ENSEMBLES, "hard")


@query(f"SELECT {RANKED}, round({DELTAS}, 6) AS max_delta FROM ({RATES})")
def slide_rates(s, d):
    return rounded(slide_table(s, d))


def _ranked(criterion: str, metric: str, name: str) -> None:
    def run(s, d):
        return rounded(rank.rank_slides(slide_table(s, d), criterion))

    run.__name__ = name
    query(f"SELECT {RANKED}, round({DELTAS}, 6) AS max_delta, round(CAST({metric} AS DOUBLE), 6) AS metric FROM ({RATES}) ORDER BY {metric} DESC, slide_id LIMIT 3")(run)


for _criterion, _metric, _name in (
    ("max_disagreement", DELTAS, "rank_slides"), ("ensemble_tpr", "tpr_deep", "rank_slides_ensemble_tpr"), ("tp_delta", "tpr_deep - tpr_c", "rank_slides_tp_delta"), ("tp_count", "tp_deep", "rank_slides_tp_count"),
):
    _ranked(_criterion, _metric, _name)


@query(f"SELECT slide_id, round({DELTAS}, 6) AS metric FROM ({RATES}) WHERE slide_id IN (SELECT DISTINCT slide_id FROM base ORDER BY slide_id LIMIT 4) ORDER BY {DELTAS} DESC, slide_id LIMIT 3")
def rank_slides_prelimit(s, d):
    return rounded(rank.rank_slides(rank.slide_table(rank.first_slides(voted(s, d), 4), MODELS, ENSEMBLES, "hard")).select("slide_id", "metric"))


# Geometry


@query("SELECT slide_id, n_vertices, count(*) FILTER (ok) AS n_valid, count(*) AS n FROM polygon_valid GROUP BY slide_id, n_vertices")
def polygon_valid(s, d):
    rows = geometry.with_validity(views.polygons(s, d)).select("slide_id", F.size("vertices").cast("long").alias("n_vertices"), F.col("valid").alias("ok"))
    return rows.groupBy("slide_id", "n_vertices").agg(F.count_if("ok").alias("n_valid"), F.count("*").alias("n"))


@query(f"""SELECT b.slide_id, b.row_idx, CAST(coalesce(h.hit, 0) AS INTEGER) AS label FROM base b LEFT JOIN (
    SELECT p.slide_id, p.row_idx, max(CAST(least(c1, c2, c3, c4) <= 0 AND greatest(c1, c2, c3, c4) >= 0 AND touching OR crosses % 2 = 1 AS INTEGER)) AS hit FROM (
    SELECT q.slide_id, q.row_idx, e.pid,
    (e.x2-e.x1)*(q.y-e.y1)-(e.y2-e.y1)*(q.x-e.x1) AS c1, (e.x2-e.x1)*(q.y-e.y1)-(e.y2-e.y1)*(q.x+{TILE}-e.x1) AS c2, (e.x2-e.x1)*(q.y+{TILE}-e.y1)-(e.y2-e.y1)*(q.x-e.x1) AS c3,
    (e.x2-e.x1)*(q.y+{TILE}-e.y1)-(e.y2-e.y1)*(q.x+{TILE}-e.x1) AS c4,
    least(e.x1,e.x2) <= q.x+{TILE} AND greatest(e.x1,e.x2) >= q.x AND least(e.y1,e.y2) <= q.y+{TILE} AND greatest(e.y1,e.y2) >= q.y AS touching,
    count(*) FILTER ((e.y1 > q.y) <> (e.y2 > q.y) AND q.x < (e.x2-e.x1)*(q.y-e.y1)/nullif(e.y2-e.y1, 0)+e.x1) OVER (PARTITION BY q.slide_id, q.row_idx, e.pid) AS crosses
    FROM base q JOIN edges e USING (slide_id) JOIN polygon_valid v ON v.pid = e.pid AND v.ok) p GROUP BY p.slide_id, p.row_idx) h USING (slide_id, row_idx)""")
def label_patches(s, d):
    return geometry.label_patches(views.base(s, d).select("slide_id", "row_idx", "x", "y"), views.polygons(s, d), TILE).select("slide_id", "row_idx", "label")


# Matching by name


@query("SELECT slide_id, min(path) AS path FROM (SELECT DISTINCT slide_id FROM base) JOIN paths ON contains(path, slide_id) GROUP BY slide_id")
def match_annotation(s, d):
    return matching.match_annotations(views.base(s, d).select("slide_id").distinct(), views.annotation_paths(s))


SUFFIX = "regexp_extract(name, '([.][^.]*)$', 1)"


@query(f"""SELECT slide_id, name FROM (SELECT DISTINCT slide_id FROM base) LEFT JOIN (SELECT slide_id, name, row_number() OVER (PARTITION BY slide_id ORDER BY CASE WHEN place > 0 THEN 0 ELSE 1 END, place, length(name), name) AS r FROM
    (SELECT slide_id, name, CASE WHEN name = slide_id || {SUFFIX} THEN coalesce(list_position(['.svs', '.tif', '.tiff', '.ndpi', '.mrxs'], {SUFFIX}), 0) ELSE 0 END AS place FROM (SELECT DISTINCT slide_id FROM base)
    JOIN images ON contains(name, slide_id) AND lower({SUFFIX}) IN ('.svs', '.tif', '.tiff', '.ndpi', '.mrxs'))) m USING (slide_id) WHERE coalesce(r, 1) = 1""")
def match_slide_image(s, d):
    slides = views.base(s, d).select("slide_id").distinct()
    named = slides.select(F.concat("slide_id", F.lit("_patches")).alias("slide_id"))
    return matching.match_images(named, views.slide_images(s)).select(matching.strip_suffix(F.col("slide_id")).alias("slide_id"), "name")


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(vec_id AS INTEGER) END AS tile_id FROM embeddings")
def tile_id_parse(s, d):
    rows = s.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "if(vec_id % 5 = 0, concat('map', vec_id), concat('x_tile', vec_id, '_tile7.png')) AS name")
    return rows.select("vec_id", matching.tile_id(F.col("name")).alias("tile_id"))


@query("SELECT CAST(vec_id // 3 AS INTEGER) AS tile_id, min('tile' || (vec_id // 3) || '_' || (vec_id % 3) || '.png') AS name FROM embeddings GROUP BY vec_id // 3")
def tile_pick_first(s, d):
    rows = s.read.parquet(f"{d}/embeddings.parquet").selectExpr("concat('tile', vec_id div 3, '_', vec_id % 3, '.png') AS name")
    return matching.first_file_per_tile(rows)


@query("SELECT vec_id, 'slide' || vec_id || '.v1' AS stem, 'slide' || vec_id AS plain FROM embeddings")
def path_names(s, d):
    rows = s.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "concat('/data/x/slide', vec_id, '.v1.h5') AS path", "concat('slide', vec_id, '_patches') AS name")
    return rows.select("vec_id", matching.stem(F.col("path")).alias("stem"), matching.strip_suffix(F.col("name")).alias("plain"))


# Grids


def _shifted(s, d):
    return views.base(s, d).withColumn("x", F.expr(f"x + if(slide_id = 'S1' AND row_idx > 0, {TILE // 2}, 0)")).withColumn("y", F.expr(f"y + if(slide_id = 'S1' AND row_idx > 0, {TILE // 2}, 0)"))


@query(f"""SELECT slide_id, round(to_corner, 6) AS to_corner, round(to_centre, 6) AS to_centre, CASE WHEN to_centre + 1e-6 < to_corner THEN 'center' ELSE 'topleft' END AS mode FROM
    (SELECT slide_id, avg(ox) + avg(oy) AS to_corner, avg(abs(ox - {TILE / 2}::DOUBLE)) + avg(abs(oy - {TILE / 2}::DOUBLE)) AS to_centre FROM
    (SELECT slide_id, (x - min(x) OVER w) % {TILE} AS ox, (y - min(y) OVER w) % {TILE} AS oy FROM
    (SELECT slide_id, x + CASE WHEN slide_id = 'S1' AND row_idx > 0 THEN {TILE // 2} ELSE 0 END AS x, y + CASE WHEN slide_id = 'S1' AND row_idx > 0 THEN {TILE // 2} ELSE 0 END AS y FROM base) WINDOW w AS (PARTITION BY slide_id)) GROUP BY slide_id)""")
def coords_mode(s, d):
    return rounded(grid.coordinate_mode(_shifted(s, d), TILE))


SNAP = f"""SELECT *, max(col) OVER w + 1 AS n_cols, max(row) OVER w + 1 AS n_rows FROM (SELECT *, CAST(round_even((x - min(x) OVER w) / {TILE}, 0) AS INTEGER) AS col, CAST(round_even((y - min(y) OVER w) / {TILE}, 0) AS INTEGER) AS row
    FROM {{}} WINDOW w AS (PARTITION BY slide_id)) WINDOW w AS (PARTITION BY slide_id)"""


@query(f"SELECT slide_id, row_idx, col, row, n_cols, n_rows FROM ({SNAP.format('base')})")
def grid_snap(s, d):
    return grid.grid_snap(views.base(s, d), TILE).select("slide_id", "row_idx", "col", "row", "n_cols", "n_rows")


CLASS = "CASE WHEN deep = 1 AND label = 1 THEN 'TP' WHEN deep = 0 AND label = 1 THEN 'FN' WHEN deep = 1 AND label = 0 THEN 'FP' ELSE 'TN' END"


def _cells(s, d):
    return grid.grid_snap(voted(s, d), TILE).withColumn("cls", grid.confusion_class(F.col("deep"), F.col("label")))


@query(f"SELECT slide_id, row_idx, col, row, {CLASS} AS cls FROM ({SNAP.format('votes')})")
def confusion_grid(s, d):
    return _cells(s, d).select("slide_id", "row_idx", "col", "row", "cls")


@query(f"""SELECT slide_id, row_idx, cls, x0, y0, x1, y1 FROM (SELECT slide_id, row_idx, {CLASS} AS cls, greatest(CAST(floor(col * (1000.0::DOUBLE / n_cols)) AS INTEGER) - 1, 0) AS x0, greatest(CAST(floor(row * (700.0::DOUBLE / n_rows)) AS INTEGER) - 1, 0) AS y0,
    least(CAST(ceil((col + 1) * (1000.0::DOUBLE / n_cols)) AS INTEGER) + 1, 1000) AS x1, least(CAST(ceil((row + 1) * (700.0::DOUBLE / n_rows)) AS INTEGER) + 1, 700) AS y1 FROM ({SNAP.format('votes')})) WHERE cls <> 'TN'""")
def draw_rects(s, d):
    return grid.draw_rectangles(_cells(s, d), 1000, 700).select("slide_id", "row_idx", "cls", "x0", "y0", "x1", "y1")


@query(f"SELECT slide_id, row_idx, n_rows - 1 - row AS col, col AS row, n_rows AS n_cols, n_cols AS n_rows FROM ({SNAP.format('base')})")
def rotate_grid(s, d):
    return grid.rotate_clockwise(grid.grid_snap(views.base(s, d), TILE)).select("slide_id", "row_idx", "col", "row", "n_cols", "n_rows")


# Overlays

W, H = views.PICTURE
_blend = lambda c, tp, fn, fp: f"list_reduce(list_prepend((7 * x + 13 * y + 31 * CAST(substr(slide_id, 2) AS INTEGER) + {50 * c}) % 256::DOUBLE, list_transform(over, lambda k: CASE k WHEN 'TP' THEN {tp} WHEN 'FN' THEN {fn} ELSE {fp} END::DOUBLE)), lambda v, k: round_even(v * (1 - 0.4::DOUBLE) + k * 0.4::DOUBLE, 0))"


@query(f"""SELECT * FROM (WITH rects AS (SELECT slide_id, row_idx, {CLASS} AS cls, greatest(CAST(floor(col * ({W}.0::DOUBLE / n_cols)) AS INTEGER) - 3, 0) AS x0, greatest(CAST(floor(row * ({H}.0::DOUBLE / n_rows)) AS INTEGER) - 3, 0) AS y0,
    least(CAST(ceil((col + 1) * ({W}.0::DOUBLE / n_cols)) AS INTEGER) + 3, {W}) AS x1, least(CAST(ceil((row + 1) * ({H}.0::DOUBLE / n_rows)) AS INTEGER) + 3, {H}) AS y1 FROM ({SNAP.format('votes')})),
    covered AS (SELECT r.slide_id, x, y, list(cls ORDER BY row_idx) AS over FROM (SELECT *, unnest(range(x0, x1)) AS x FROM rects WHERE cls <> 'TN') r, range(y0, y1) u(y) GROUP BY ALL),
    canvas AS (SELECT slide_id, x, y, coalesce(over, []) AS over FROM (SELECT slide_id, x, y FROM (SELECT DISTINCT slide_id FROM base), range({W}) a(x), range({H}) b(y)) LEFT JOIN covered USING (slide_id, x, y)),
    pixels AS (SELECT slide_id, {H} - 1 - y AS u, x AS v, CAST({_blend(0, 0, 255, 0)} AS BIGINT) AS r, CAST({_blend(1, 255, 0, 0)} AS BIGINT) AS g, CAST({_blend(2, 0, 0, 255)} AS BIGINT) AS b FROM canvas)
    SELECT slide_id, {H} AS width, {W} AS height, CAST(sum(r) AS BIGINT) AS red, CAST(sum(g) AS BIGINT) AS green, CAST(sum(b) AS BIGINT) AS blue, CAST(sum((r + 2 * g + 3 * b) * (1 + (31 * u + 17 * v) % 97)) AS BIGINT) AS placed
    FROM pixels GROUP BY slide_id)""")
def overlay_sums(s, d):
    """Sums of the channels of each slide's overlay, turned, and one that depends on where each pixel lies."""
    rects = grid.draw_rectangles(_cells(s, d), W, H, pad=3)
    return overlay.sums(overlay.overlay(views.pictures(s, d), rects, rows=50))


# Dice

OTSU = """SELECT tile_id, centre AS threshold FROM (SELECT tile_id, bin, centre, row_number() OVER (PARTITION BY tile_id ORDER BY
    round(coalesce(w0 * (w - w0) * (s0 / nullif(w0, 0) - (s - s0) / nullif(w - w0, 0)) * (s0 / nullif(w0, 0) - (s - s0) / nullif(w - w0, 0)), 0), 6) DESC, bin) AS r FROM
    (SELECT tile_id, bin, centre, sum(n) OVER up AS w0, sum(n * centre) OVER up AS s0, sum(n) OVER al AS w, sum(n * centre) OVER al AS s FROM
    (SELECT t.tile_id, b.bin, (b.bin + 0.5::DOUBLE) / 256 AS centre, CAST(count(m.v) AS DOUBLE) AS n FROM (SELECT DISTINCT tile_id FROM {0}) t CROSS JOIN (SELECT range AS bin FROM range(256)) b
    LEFT JOIN (SELECT tile_id, {1} AS v, least(floor({1} * 256), 255) AS bin FROM {0}) m ON m.tile_id = t.tile_id AND m.bin = b.bin GROUP BY t.tile_id, b.bin)
    WINDOW up AS (PARTITION BY tile_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), al AS (PARTITION BY tile_id))) WHERE r = 1"""


def _sql_dice(foreground: str, hard: str | None, columns: str) -> str:
    q = lambda spec, side: f"(SELECT tile_id, {'quantile_cont(' + side + ', ' + spec[1:] + ' / 100.0)' if spec[0] == 'p' else spec} AS t FROM pair GROUP BY tile_id)" if spec != "otsu" else f"({OTSU.format('pair', side).replace('threshold', 't')})"
    joins = f"JOIN {q(foreground, 'a')} fa USING (tile_id) JOIN {q(foreground, 'b')} fb USING (tile_id)" + (f" JOIN {q(hard, 'a')} ha USING (tile_id) JOIN {q(hard, 'b')} hb USING (tile_id)" if hard else "")
    soft = "2 * coalesce(sum(a * b) FILTER (m), 0) / (coalesce(sum(a * a) FILTER (m), 0) + coalesce(sum(b * b) FILTER (m), 0) + 1e-8)"
    both = "2 * count(*) FILTER (m AND ah AND bh) / (count(*) FILTER (m AND ah) + count(*) FILTER (m AND bh) + 1e-8::DOUBLE)"
    inner = "SELECT tile_id, a, b, a >= fa.t OR b >= fb.t AS m, fa.t AS fga, fb.t AS fgb" + (", ha.t AS hta, hb.t AS htb, a >= ha.t AS ah, b >= hb.t AS bh" if hard else "") + f" FROM pair {joins}"
    columns = columns.replace("@soft", f"round({soft}, 6) AS soft_dice").replace("@hard", f"round({both}, 6) AS hard_dice, round(CAST(any_value(hta) AS DOUBLE), 6) AS hard_thr_a, round(CAST(any_value(htb) AS DOUBLE), 6) AS hard_thr_b")
    return f"SELECT tile_id, {columns} FROM ({inner}) GROUP BY tile_id"


def _dice(name: str, foreground: str, hard: str | None, soft: bool, sql: str, columns: list[str]) -> None:
    def run(s, d):
        a, b = views.maps(s, d)
        return rounded(dice.compare(a, b, dice.parse_threshold(foreground), dice.parse_threshold(hard) if hard else None, soft).select("tile_id", *columns))

    run.__name__ = name
    query(_sql_dice(foreground, hard, sql))(run)


FG = "round(any_value(fga), 6) AS fg_thr_a, round(any_value(fgb), 6) AS fg_thr_b, round(avg(CAST(m AS DOUBLE)), 6) AS fg_fraction"
HARD = ["hard_dice", "hard_thr_a", "hard_thr_b"]
_dice("dice_soft", "p10", None, True, "@soft", ["soft_dice"])
_dice("dice_fg_fraction", "p10", None, True, FG, ["fg_thr_a", "fg_thr_b", "fg_fraction"])
_dice("dice_hard_percentile", "p10", "p50", False, "@hard", HARD)
_dice("dice_hard_numeric", "p10", "0.6", False, "@hard", HARD)
_dice("dice_hard_otsu", "p10", "otsu", True, "@soft, @hard", ["soft_dice", *HARD])


@query(_sql_dice("p10", None, "@soft").replace(" FROM pair ", " FROM (SELECT * FROM pair WHERE tile_id IN (SELECT DISTINCT tile_id FROM pair ORDER BY tile_id LIMIT 50)) pair "))
def dice_match_limit(s, d):
    a, b = views.maps(s, d)
    return rounded(dice.compare(a, b, dice.parse_threshold("p10"), limit=50).select("tile_id", "soft_dice"))


@query(f"SELECT round(avg(soft_dice), 6) AS mean, round(median(soft_dice), 6) AS median, round(coalesce(stddev_samp(soft_dice), 0), 6) AS std, count(*) AS n FROM ({_sql_dice('p10', None, '@soft').replace('round(2 *', '(2 *').replace(', 6) AS soft_dice', ') AS soft_dice')})")
def dice_summary(s, d):
    a, b = views.maps(s, d)
    return rounded(metrics.score_summary(dice.compare(a, b, dice.parse_threshold("p10")), "soft_dice"))


@query(OTSU.format("map_a", "v").replace("centre AS threshold", "round(centre, 6) AS threshold"))
def otsu_threshold(s, d):
    return rounded(dice.otsu(views.maps(s, d)[0]))


# Attention


def _patch_vector(s, d, tokens=10):
    return attention.as_pixels(attention.patch_vectors(views.attention_heads(s, d, tokens), 2, tokens, 1))


@query("SELECT tile_id, i, j, round(a, 6) AS a FROM head_mean")
def attn_head_mean(s, d):
    return rounded(attention.as_pairs(attention.head_means(views.attention_heads(s, d), 2, 10, 1), 10))


@query("SELECT tile_id, i, j, round(a, 6) AS a FROM head_mean WHERE tile_id IN (SELECT DISTINCT tile_id FROM head_mean ORDER BY tile_id LIMIT 100)")
def attn_tile_limit(s, d):
    tiles = attention.first_tiles(views.attention_heads(s, d))
    return rounded(attention.as_pairs(attention.head_means(tiles, 2, 10, 1), 10))


@query("SELECT tile_id, pix, round(v, 6) AS v FROM patch_vec")
def attn_patch_vector(s, d):
    return rounded(_patch_vector(s, d))


@query("SELECT tile_id, j AS pix, round(avg(a), 6) AS v FROM (SELECT tile_id, head, i, j, exp(s - ms) / sum(exp(s - ms)) OVER (PARTITION BY tile_id, head, i) AS a FROM (SELECT *, max(s) OVER (PARTITION BY tile_id, head, i) AS ms FROM att_scores WHERE i < 9 AND j < 9)) GROUP BY tile_id, j")
def attn_patch_vector_no_token(s, d):
    return rounded(_patch_vector(s, d, 9))


@query("SELECT tile_id, pix, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8), 6) AS v FROM patch_vec WINDOW w AS (PARTITION BY tile_id)")
def attn_normalize(s, d):
    return rounded(attention.normalise(_patch_vector(s, d)))


@query("""SELECT n, CAST(side AS INTEGER) AS side, CAST(n - side * side AS INTEGER) AS special FROM (SELECT n, CASE WHEN floor(sqrt(n)) * floor(sqrt(n)) = n THEN floor(sqrt(n)) ELSE floor(sqrt(n - 1)) END AS side FROM
    (SELECT CAST(vec_id + 1 AS INTEGER) AS n FROM embeddings))""")
def token_layout(s, d):
    n = F.col("n")
    side, special = attention.token_layout(n)
    return s.read.parquet(f"{d}/embeddings.parquet").selectExpr("CAST(vec_id + 1 AS INT) AS n").select("n", side.alias("side"), special.alias("special"))


@query("""SELECT tile_id, CAST(r * 7 + c AS INTEGER) AS pix, round(sum(v * wr * wc), 6) AS v FROM patch_vec
    JOIN (SELECT r, y0 AS y, 1 - fy AS wr FROM (SELECT r, y0, place - y0 AS fy FROM (SELECT r, place, floor(place) AS y0 FROM (SELECT range AS r, least(greatest((range + 0.5::DOUBLE) * 3 / 7 - 0.5, 0), 2) AS place FROM range(7)))) UNION ALL
          SELECT r, least(y0 + 1, 2), fy FROM (SELECT r, y0, place - y0 AS fy FROM (SELECT r, place, floor(place) AS y0 FROM (SELECT range AS r, least(greatest((range + 0.5::DOUBLE) * 3 / 7 - 0.5, 0), 2) AS place FROM range(7))))) rr ON rr.y = pix // 3
    JOIN (SELECT c, x0 AS x, 1 - fx AS wc FROM (SELECT c, x0, place - x0 AS fx FROM (SELECT c, place, floor(place) AS x0 FROM (SELECT range AS c, least(greatest((range + 0.5::DOUBLE) * 3 / 7 - 0.5, 0), 2) AS place FROM range(7)))) UNION ALL
          SELECT c, least(x0 + 1, 2), fx FROM (SELECT c, x0, place - x0 AS fx FROM (SELECT c, place, floor(place) AS x0 FROM (SELECT range AS c, least(greatest((range + 0.5::DOUBLE) * 3 / 7 - 0.5, 0), 2) AS place FROM range(7))))) cc ON cc.x = pix % 3
    GROUP BY tile_id, r, c""")
def bilinear_resize(s, d):
    return rounded(attention.bilinear(_patch_vector(s, d), 3, 7))


_pass = lambda table, side, other: f"(SELECT tile_id, {other}, o AS {side}, least(255, greatest(0, (CAST(sum(q * k) AS BIGINT) + 2097152) >> 22)) AS q FROM {table} JOIN w ON w.i = {side} GROUP BY tile_id, {other}, o)"


@query(f"""SELECT * FROM (WITH w AS (SELECT o, i, CAST(floor(v / sum(v) OVER (PARTITION BY o) * 4194304 + 0.5) AS BIGINT) AS k FROM (SELECT o, i, greatest(0, 1 - abs((i + 0.5::DOUBLE) - (o + 0.5::DOUBLE) * 1.6::DOUBLE) / 1.6::DOUBLE) AS v FROM range(5) a(o), range(8) b(i))),
    bytes AS (SELECT tile_id, pix // 8 AS r, pix % 8 AS c, CAST(floor(v * 255) AS BIGINT) AS q FROM map_a)
    SELECT tile_id, CAST(5 * r + c AS INTEGER) AS pix, round(q / 255::DOUBLE, 6) AS v FROM {_pass(_pass('bytes', 'c', 'r'), 'r', 'c')})""")
def resize_requantised(s, d):
    """Maps of 8 by 8 shrunk to 5 by 5 by way of bytes."""
    maps = views.maps(s, d)[0].groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("pix", "v"))).alias("p")).select("tile_id", F.col("p.v").alias("pixels"))
    small = resize.resized(F.col("pixels"), F.lit(8), F.lit(8), F.lit(5), F.lit(5))
    return rounded(maps.select("tile_id", F.posexplode(small).alias("pix", "v")))


# Models and samples: no SQL gives the training's result


@query(None)
def train_and_vote(s, d):
    """Nine networks of the reference's layers and epochs, one a source, trained on all aligned rows, and their majority on the test rows."""
    rows = align.align_keys(keyed(s, d), 9, ("label", "row_idx", "vec_id"))
    rows = rows.select("key", "label", F.explode("parts").alias("p")).select("key", "label", "p.source_id", "p.row_idx", "p.vec_id")
    features = views.base(s, d).select("vec_id", F.col("e").alias("features"))
    rows = split.three_way(rows, F.col("vec_id"), ["source_id", "label"]).join(features, "vec_id")  # features are shuffled behind the ranks
    networks = model.networks_of(model.train_by_source(rows, hidden=model.HIDDEN, epochs=30, batch=256, norm=True, dropout=model.DROPOUT, drop_last=True).select("model", "layer", "inputs", "outputs", "w", "b"))
    out = rows.where("split = 'test'").where("source_id = 0").select("key", "label", "features")
    for name, net in sorted(networks.items()):
        out = model.score(out, net, name=f"_{name}")
    return out.select("key", "label", votes.hard_vote([F.col(f"pred_{n}") for n in sorted(networks)]).alias("vote"))


DRAWN = "CAST(concat('0x', substr(md5('42|{}|' || draw), 1, 14)) AS BIGINT)"


@query(f"""SELECT draw, vec_id, label FROM (SELECT draw, cls, {DRAWN.format('rank')} % n + 1 AS r FROM (SELECT range AS draw, {DRAWN.format('class')} % (SELECT count(DISTINCT label) FROM base) AS cls
    FROM (SELECT unnest(range((SELECT count(*) FROM base))) AS range)) JOIN (SELECT row_number() OVER (ORDER BY label) - 1 AS cls, count(*) AS n FROM base GROUP BY label) USING (cls))
    JOIN (SELECT vec_id, label, {ORDER.format('PARTITION BY label')} AS r, dense_rank() OVER (ORDER BY label) - 1 AS cls FROM base) USING (cls, r)""")
def weighted_resample(s, d):
    return split.weighted_resample(views.base(s, d).select("vec_id", "label"), F.col("vec_id")).select("draw", "vec_id", "label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
