"""Models whose every step SQL can repeat: cuts, histograms, features and neighbour counts next to the fitted results."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from catalog.inputs import labels, snapshots, with_embeddings, with_tables
from catalog.model_queries import IN_TEST, IN_VAL, NEAR_COLUMNS, NEAR_SQL, train_of
from catalog.model_queries import scaled_sessions as near_sessions
from catalog.registry import query, r, sr
from snapweave.operators import prep, splits
from snapweave.operators import tables as tab
from snapweave.operators.aggregates import embedding_dim, length_percentile, session_meta, with_class_weight
from snapweave.operators.information import neighbour_information
from snapweave.operators.neighbours import nearest_neighbours
from snapweave.operators.neighbours_lsh import approximate_neighbours, recall
from snapweave.plans import boosting as bo
from snapweave.plans import extra_trees as xt
from snapweave.plans import kernel, recurrent, training
from snapweave.runtime import materialize
from snapweave.schema import KEYS

# Session features in both languages; rounded, so that both engines cut the same numbers.
FEATURES = {
    "rows_in_session": ("count(1)", "count(*)"),
    "mean_seconds": ("avg(seconds_from_start)",) * 2,
    "most_keystrokes": ("max(keystrokes_before_snapshot)",) * 2,
    "all_executes": ("sum(executes_before_snapshot)",) * 2,
    "most_feedback": ("max(ai_feedback_before_snapshot)",) * 2,
    "mean_saves": ("avg(saves_before_snapshot)",) * 2,
}
COLUMNS = list(FEATURES)
COLUMN_LIST = "[" + ", ".join(f"'{c}'" for c in COLUMNS) + "]"


def session_rows(spark, sf):
    """Labelled sessions with their features, split by user and with class numbers; and the class names."""
    rows = tab.drop_unlabelled(tab.attach(snapshots(spark, sf, chars=False), labels(spark, sf)))
    wide = rows.groupBy(*KEYS, "label").agg(*[r(F.expr(a).cast("double")).alias(c) for c, (a, _) in FEATURES.items()])
    wide = materialize(splits.split_by_user(wide), "wide")
    indexer = training.label_indexer(train_of(wide))
    return materialize(indexer.transform(wide), "sessions"), indexer.labels


SESSIONS = {
    "wide": f"""SELECT user_id, exercise_id, label, {', '.join(sr(b, c) for c, (_, b) in FEATURES.items())}, {IN_TEST} AS held
        FROM snaps JOIN true_labels USING (user_id, exercise_id) WHERE label IS NOT NULL GROUP BY ALL""",
    "class_names": "SELECT list(DISTINCT label ORDER BY label) AS names FROM wide WHERE NOT held",
    "sessions": f"""SELECT user_id, exercise_id, label, held, [{', '.join(COLUMNS)}] AS x, list_position(names, label) AS y
        FROM wide, class_names""",
}


# --- M3: extra trees ------------------------------------------------------------------------------------


def _draw_sql(purpose: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:{purpose}:' || tree || ':' || node || ':' || feature), 1, 13)) AS BIGINT) / {float(16**13)}"


def _level_sql(level: int, k: int) -> dict[str, str]:
    """One level of all trees: ``at{level}`` holds every train row with its node, ``best{level}`` the cuts taken."""
    at = f"at{level}"
    return {
        f"open{level}": f"SELECT tree, node FROM {at} WHERE NOT held GROUP BY tree, node HAVING count(*) >= 2 AND count(DISTINCT y) > 1",
        f"cell{level}": f"""SELECT tree, node, feature, min(x[feature + 1]) AS low, max(x[feature + 1]) AS high
            FROM {at} JOIN open{level} USING (tree, node), range({len(COLUMNS)}) f(feature) WHERE NOT held GROUP BY ALL HAVING low < high""",
        f"cand{level}": f"""SELECT tree, node, feature, low + {_draw_sql('cut')} * (high - low) AS cut FROM cell{level}
            QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {_draw_sql('order')}, feature) <= {k}""",
        f"side{level}": f"""SELECT tree, node, feature, cut, x[feature + 1] < cut AS is_left, y, CAST(count(*) AS DOUBLE) AS w
            FROM {at} JOIN cand{level} USING (tree, node) WHERE NOT held GROUP BY ALL""",
        f"score{level}": f"""SELECT tree, node, feature, cut, round(sum(p), 9) AS score FROM
            (SELECT tree, node, feature, cut, is_left, sum(w * w) / sum(w) AS p FROM side{level} GROUP BY ALL)
            GROUP BY ALL HAVING count(*) = 2""",
        f"best{level}": f"SELECT * FROM score{level} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY score DESC, feature) = 1",
        f"at{level + 1}": f"""SELECT a.* EXCLUDE (node), CASE WHEN b.feature IS NULL THEN a.node
            ELSE 2 * a.node + CASE WHEN x[b.feature + 1] < b.cut THEN 0 ELSE 1 END END AS node
            FROM {at} a LEFT JOIN best{level} b ON a.tree = b.tree AND a.node = b.node""",
    }


SMALL_TREES, SMALL_DEPTH = 8, 2
FOREST = SESSIONS | {"at0": f"SELECT *, 1 AS node FROM sessions, range({SMALL_TREES}) t(tree)"}
for _level in range(SMALL_DEPTH):
    FOREST |= _level_sql(_level, int(len(COLUMNS) ** 0.5))
FOREST |= {
    "leaves": f"SELECT tree, node, y, count(*) / sum(count(*)) OVER (PARTITION BY tree, node) AS share FROM at{SMALL_DEPTH} WHERE NOT held GROUP BY tree, node, y",
    "voted": f"""SELECT user_id, exercise_id, a.label, l.y, sum(share) / {SMALL_TREES} AS share
        FROM at{SMALL_DEPTH} a JOIN leaves l ON a.tree = l.tree AND a.node = l.node WHERE held GROUP BY user_id, exercise_id, a.label, l.y""",
}


def _forest_sql(body: str) -> str:
    return with_tables(body, "snaps", "true_labels", extra=FOREST)


def small_forest(spark, sf):
    rows, names = session_rows(spark, sf)
    return rows, names, xt.fit_extra_trees(train_of(rows), COLUMNS, len(names), trees=SMALL_TREES, depth=SMALL_DEPTH)


@query(
    "m3_extra_trees_cuts",
    _forest_sql(
        " UNION ALL ".join(
            f"SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS BIGINT) AS node, {COLUMN_LIST}[feature + 1] AS feature, {sr('cut', 'cut', 6)} FROM best{n}"
            for n in range(SMALL_DEPTH)
        )
    ),
)
def m3_cuts(spark, sf):
    """Every cut of a small forest: drawn and chosen in Spark, and once more in SQL."""
    _, _, forest = small_forest(spark, sf)
    return forest.split_table(spark).filter("feature IS NOT NULL").select("tree", "node", "feature", r("cut", 6).alias("cut"))


@query(
    "m3_extra_trees_votes",
    _forest_sql(
        f"""SELECT user_id, exercise_id, label, names[arg_max(y, (round(share, 9), -y))] AS pred_label, {sr('max(share)', 'proba', 6)}
            FROM voted, class_names GROUP BY user_id, exercise_id, label, names"""
    ),
)
def m3_votes(spark, sf):
    """Mean class shares of the small forest's leaves for every test session."""
    rows, names, forest = small_forest(spark, sf)
    scored = forest.predict(rows.filter("split = 'test'"))
    best = F.transform("probability", lambda p: F.round(p, 9))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(best, F.array_max(best)).cast("int"))
    return scored.select(*KEYS, "label", label.alias("pred_label"), r(F.array_max("probability"), 6).alias("proba"))


@query("m3_extra_trees_full")
def m3_full(spark, sf):
    """The forest at its usual size (300 trees, leaves of one class): class probabilities of every test session."""
    rows, names = session_rows(spark, sf)
    weighted = training_weights(rows)
    forest = xt.fit_extra_trees(train_of(weighted), COLUMNS, len(names), weight="weight")
    return named(forest.predict(rows.filter("split = 'test'")), names)


def training_weights(rows):
    """Training rows with weights that balance the classes."""
    return with_class_weight(train_of(rows))


def named(scored, names):
    """Keys, label, predicted label and one probability column per class."""
    shown = training.named_predictions(scored, names)
    return shown.select(*KEYS, "label", "pred_label", *[f"proba_{n}" for n in names])


# --- M4: boosting -------------------------------------------------------------------------------------------

FIRST = bo.Settings(rounds=1, bins=16)


def _gain_level(level: int) -> dict[str, str]:
    """Cuts of one level of the first round's trees, one tree per class ``c``."""
    at = f"step{level}"
    g, h, s = "sum(g) FILTER (x[feature + 1] <= edge)", "sum(h) FILTER (x[feature + 1] <= edge)", FIRST.hold
    return {
        f"gain{level}": f"""SELECT c, node, feature, edge, round(coalesce({g}, 0) ** 2 / (coalesce({h}, 0) + {s})
              + (sum(g) - coalesce({g}, 0)) ** 2 / (sum(h) - coalesce({h}, 0) + {s}) - sum(g) ** 2 / (sum(h) + {s}), 9) AS gain
            FROM {at}, edges WHERE NOT held GROUP BY c, node, feature, edge
            HAVING least(count(*) FILTER (x[feature + 1] <= edge), count(*) FILTER (x[feature + 1] > edge)) >= {FIRST.least}""",
        f"cut{level}": f"SELECT * FROM gain{level} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY c, node ORDER BY gain DESC, feature, edge) = 1",
        f"step{level + 1}": f"""SELECT a.* EXCLUDE (node), 2 * a.node + CASE WHEN k.feature IS NULL OR x[k.feature + 1] <= k.edge THEN 1 ELSE 2 END AS node
            FROM {at} a LEFT JOIN cut{level} k ON a.c = k.c AND a.node = k.node""",
    }


BOOST = SESSIONS | {
    "edges": f"""SELECT DISTINCT feature, sorted[CAST(ceil(len(sorted) * i / {FIRST.bins}) AS INTEGER)] AS edge FROM
        (SELECT feature, list(x[feature + 1] ORDER BY x[feature + 1]) AS sorted FROM sessions, range({len(COLUMNS)}) f(feature) WHERE NOT held GROUP BY feature), range(1, {FIRST.bins}) b(i)""",
    "share": "SELECT y AS c, count(*) / sum(count(*)) OVER () AS p FROM sessions WHERE NOT held GROUP BY y",
    "step0": "SELECT s.*, c, 0 AS node, p, p - CASE WHEN y = c THEN 1 ELSE 0 END AS g, p * (1 - p) AS h FROM sessions s, share",
}
for _level in range(FIRST.depth):
    BOOST |= _gain_level(_level)
BOOST |= {
    "value": f"SELECT c, node, -{FIRST.rate} * sum(g) / (sum(h) + {FIRST.hold}) AS v FROM step{FIRST.depth} WHERE NOT held GROUP BY c, node",
    "raised": f"""SELECT user_id, exercise_id, label, s.c, exp(ln(p) + coalesce(v, 0)) AS e
        FROM step{FIRST.depth} s LEFT JOIN value l ON l.c = s.c AND l.node = s.node WHERE held""",
}


def boosted(spark, sf, settings, weight=None):
    rows, names = session_rows(spark, sf)
    train = training_weights(rows) if weight else train_of(rows)
    return rows, names, bo.fit_boosted(train, COLUMNS, len(names), weight=weight, settings=settings)


@query(
    "m4_boosting_first_cuts",
    with_tables(
        " UNION ALL ".join(
            f"SELECT CAST(c - 1 AS INTEGER) AS class, CAST(node AS INTEGER) AS node, {COLUMN_LIST}[feature + 1] AS feature, {sr('edge', 'cut', 6)} FROM cut{n}"
            for n in range(FIRST.depth)
        ),
        "snaps", "true_labels", extra=BOOST,
    ),
)
def m4_cuts(spark, sf):
    """Every cut of the first round: histograms of gradient and curvature in Spark, plain sums in SQL."""
    _, _, model = boosted(spark, sf, FIRST)
    return model.cut_table(spark).select("class", "node", "feature", r("cut", 6).alias("cut"))


@query(
    "m4_boosting_first_chances",
    with_tables(
        f"SELECT user_id, exercise_id, label, CAST(c - 1 AS INTEGER) AS class, {sr('e / sum(e) OVER (PARTITION BY user_id, exercise_id)', 'chance', 6)} FROM raised",
        "snaps", "true_labels", extra=BOOST,
    ),
)
def m4_chances(spark, sf):
    """Class probabilities of every test session after the first round."""
    rows, _, model = boosted(spark, sf, FIRST)
    scored = model.predict(rows.filter("split = 'test'")).select(*KEYS, "label", F.posexplode("probability").alias("class", "p"))
    return scored.select(*KEYS, "label", "class", r("p", 6).alias("chance"))


@query("m4_boosting_full")
def m4_full(spark, sf):
    """100 rounds of depth 3 with balanced weights: class probabilities of every test session."""
    rows, names, model = boosted(spark, sf, bo.Settings(), "weight")
    return named(model.predict(rows.filter("split = 'test'")), names)


# --- M5: kernel -----------------------------------------------------------------------------------------------

DIRECTIONS, GAMMA = 16, 0.125


def _uniform_sql(purpose: str, parts: str) -> str:
    return f"CAST(('0x' || substr(md5('42:{purpose}:' || {parts}), 1, 13)) AS BIGINT) / {float(16**13)}"


def scaled_sessions(spark, sf):
    rows, names = session_rows(spark, sf)
    return prep.fit_scaler(train_of(rows), COLUMNS).apply(rows), names


@query(
    "m5_fourier_features",
    with_tables(
        f"""SELECT user_id, exercise_id, CAST(j AS INTEGER) AS direction, {sr(f'sqrt(2.0 / {DIRECTIONS}) * cos(sum(v * w) + any_value(phase))', 'value', 6)}
            FROM values JOIN draws USING (i) GROUP BY user_id, exercise_id, j""",
        "snaps", "true_labels",
        extra=SESSIONS
        | {
            "cells": f"SELECT user_id, exercise_id, held, i, x[i + 1] AS raw FROM sessions, range({len(COLUMNS)}) c(i)",
            "spread": "SELECT i, avg(raw) AS m, CASE WHEN stddev_pop(raw) = 0 THEN 1 ELSE stddev_pop(raw) END AS s FROM cells WHERE NOT held GROUP BY i",
            "values": "SELECT user_id, exercise_id, i, (raw - m) / s AS v FROM cells JOIN spread USING (i)",
            "draws": f"""SELECT i, j, sqrt(2.0 * {GAMMA}) * sqrt(-2 * ln(1 - {_uniform_sql('radius', "j || ':' || i")})) * cos(2 * pi() * {_uniform_sql('angle', "j || ':' || i")}) AS w,
                2 * pi() * {_uniform_sql('phase', 'j')} AS phase FROM range({len(COLUMNS)}) c(i), range({DIRECTIONS}) d(j)""",
        },
    ),
)
def m5_features(spark, sf):
    """Random Fourier features of scaled sessions, drawn by md5 in both engines."""
    rows, _ = scaled_sessions(spark, sf)
    mapped = kernel.FourierFeatures(tuple(COLUMNS), GAMMA, DIRECTIONS).apply(rows)
    return mapped.select(*KEYS, F.posexplode("fourier").alias("direction", "v")).select(*KEYS, "direction", r("v", 6).alias("value"))


@query("m5_kernel_svm")
def m5_full(spark, sf):
    """RBF machine at strength 1 and the usual width: predicted label of every test session."""
    rows, names = scaled_sessions(spark, sf)
    train = train_of(rows)
    features = kernel.FourierFeatures(tuple(COLUMNS), kernel.scale_gamma(train, COLUMNS))
    ready, n = kernel.with_kernel_vector(rows, features), train.count()
    fitted = kernel.fit_by_class(kernel.rbf_svm(n, parallelism=4), train_of(ready), n, features.size)
    return training.predictions(fitted, ready.filter("split = 'test'"), names).select(*KEYS, "label", "pred_label")


# --- F10: information by neighbours -----------------------------------------------------------------------------

PSI = (
    "(ln({n} + 6) - 1 / (2 * ({n} + 6)) - 1 / (12 * ({n} + 6) ** 2) + 1 / (120 * ({n} + 6) ** 4) - 1 / (252 * ({n} + 6) ** 6) - "
    + " - ".join(f"1 / ({{n}} + {i})" for i in range(6)) + ")"
)


def _psi(n: str) -> str:
    return PSI.format(n=f"CAST({n} AS DOUBLE)")


@query(
    "f10_neighbour_information",
    with_tables(
        f"""SELECT feature, {sr(f"greatest(0, {_psi('count(*)')} + avg({_psi('k')} - {_psi('of_label')} - {_psi('m')}))", 'mi', 6)} FROM counted GROUP BY feature""",
        "snaps", "true_labels",
        extra=SESSIONS
        | {
            "cells": f"""SELECT {COLUMN_LIST}[i + 1] AS feature, label, x[i + 1] AS v, row_number() OVER () AS id, count(*) OVER (PARTITION BY i, label) AS of_label
                FROM sessions, range({len(COLUMNS)}) c(i) WHERE NOT held QUALIFY of_label > 1""",
            "near": """SELECT a.feature, a.id, a.v, a.of_label, least(3, a.of_label - 1) AS k, abs(a.v - b.v) AS r FROM cells a JOIN cells b
                ON a.feature = b.feature AND a.label = b.label AND a.id <> b.id
                QUALIFY row_number() OVER (PARTITION BY a.feature, a.id ORDER BY abs(a.v - b.v)) = least(3, a.of_label - 1)""",
            "counted": """SELECT n.feature, n.id, any_value(n.k) AS k, any_value(n.of_label) AS of_label, count(*) AS m FROM near n JOIN cells c
                ON c.feature = n.feature AND abs(c.v - n.v) <= n.r * (1 - 1e-9) GROUP BY n.feature, n.id""",
        },
    ),
)
def f10_neighbours(spark, sf):
    rows, _ = session_rows(spark, sf)
    found = neighbour_information(train_of(rows), COLUMNS)
    return found.select("feature", r("mi", 6).alias("mi"))


# --- M8: a recurrent net over whole snapshot vectors -----------------------------------------------------------

NUMBERS = ["seconds_from_start", "saves_before_snapshot", "keystrokes_before_snapshot", "executes_before_snapshot", "task_code_cosine"]
CATEGORIES = ["event_type", "exercise_type"]
COMPONENTS = 16
EVENT = ["event_id", *KEYS]
ORDER = ["snapshot_sequence_num"]
PARTS = [*NUMBERS, *CATEGORIES, "code_embedding", "task_embedding"]


def sequence_frame(spark, sf):
    """Sessions as padded sequences of vectors: numbers, both embeddings reduced, categories; scaled as a whole.

    Everything is fitted on the training rows. A fifth of the training users, by hash, is for stopping; if that
    would lose a class from training, sessions are drawn by class instead.
    """
    # Labels meet the rows before these get their embeddings, and only what the sequences are made of is written.
    rows = tab.drop_unlabelled(tab.attach(snapshots(spark, sf, chars=False), labels(spark, sf)))
    rows = with_embeddings(spark, sf, rows).select(*EVENT, "label", *ORDER, *PARTS)
    rows = materialize(splits.train_validation(splits.split_by_user(rows)), "split")
    rows = prep.fit_mean_fill(train_of(rows), NUMBERS).apply(rows)
    parts = list(NUMBERS)
    for column in ("code_embedding", "task_embedding"):
        dim = embedding_dim(train_of(rows), column, ["event_id"]).first()["dim"]
        model = training.fit_embedding_pca(train_of(rows), column, dim, COMPONENTS)
        rows = training.apply_embedding_pca(rows, column, dim, model).withColumn(f"{column}_v", array_to_vector(f"{column}_pca"))
        parts.append(f"{column}_v")
    rows = training.one_hot(train_of(rows), CATEGORIES).transform(rows)
    vectors = training.assemble(rows, [*parts, *[f"{c}_onehot" for c in CATEGORIES]])
    vectors = materialize(vectors.select(*EVENT, "label", "split", *ORDER, "features"), "vectors")
    scaled = training.scale_vectors(train_of(vectors), "features").transform(vectors)
    scaled = scaled.withColumn("v", vector_to_array("features_scaled"))
    width = scaled.agg(F.max(F.size("v"))).first()[0]
    lengths = train_of(session_meta(scaled, ["snapshot_sequence_num"], ["split"]))
    maxlen = length_percentile(lengths, 0.9).first()["maxlen"]
    padded = materialize(prep.padded_sequences(scaled, ["v"], maxlen, carry=["label", "split"], width=width), "padded")
    indexer = training.label_indexer(padded.filter("split <> 'test'"))
    return indexer.transform(padded), width, indexer.labels


def fitted_sequences(spark, sf):
    padded, width, names = sequence_frame(spark, sf)
    train = with_class_weight(padded.filter("split <> 'test'")).withColumn("stop", F.col("split") == "validation")
    return padded, names, recurrent.fit_recurrent(train, width, len(names), held="stop", weight="weight")


@query("m8_recurrent_net")
def m8_full(spark, sf):
    """Class probabilities of every test session."""
    padded, names, model = fitted_sequences(spark, sf)
    return named(model.predict(padded.filter("split = 'test'")), names)


@query(
    "m8_sequence_vectors",
    with_tables(
        f"""SELECT user_id, exercise_id, label, least(n, m) AS length,
              {len(NUMBERS) + 2 * COMPONENTS} + (SELECT count(DISTINCT event_type) + count(DISTINCT exercise_type) FROM embedded JOIN true_labels USING (user_id, exercise_id) WHERE label IS NOT NULL AND NOT ({IN_TEST})) AS width,
              m AS steps, TRUE AS padding_is_zero
            FROM counted, (SELECT greatest(2, CAST(floor(quantile_cont(n, 0.9)) AS INTEGER)) AS m FROM counted WHERE NOT ({IN_TEST}) AND NOT val)""",
        "embedded", "true_labels",
        extra={
            "counted": f"""SELECT user_id, exercise_id, label, count(*) AS n, {IN_VAL} AS val FROM embedded JOIN true_labels USING (user_id, exercise_id)
                WHERE label IS NOT NULL GROUP BY ALL"""
        },
    ),
)
def m8_vectors(spark, sf):
    """What the net reads: real steps per session, width of a step, and that nothing follows the last real one."""
    padded, _, _ = sequence_frame(spark, sf)
    zero = F.forall(F.flatten(F.slice("sequence", F.col("length") + 1, F.size("sequence"))), lambda v: v == 0)
    return padded.select(
        *KEYS, "label", "length", F.size(F.col("sequence")[0]).alias("width"), F.size("sequence").alias("steps"), zero.alias("padding_is_zero")
    )


# --- folds of few users, values of models --------------------------------------------------------------------------

FEW_USERS = ["Student_8", "Student_10", "Student_13"]


@query(
    "g6_folds_of_few_users",
    with_tables(
        f"""SELECT user_id, exercise_id, CAST(fold AS INTEGER) AS fold, CAST((SELECT count(DISTINCT user_id) FROM few) AS INTEGER) AS folds FROM few JOIN
              (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS fold FROM few GROUP BY user_id) USING (user_id)""",
        "true_labels",
        extra={"few": f"SELECT * FROM true_labels WHERE user_id IN ({', '.join(repr(u) for u in FEW_USERS)})"},
    ),
)
def g6_few(spark, sf):
    """Fewer users than folds: one fold each."""
    rows, k = splits.grouped_folds(labels(spark, sf).filter(F.col("user_id").isin(FEW_USERS)))
    return rows.select(*KEYS, "fold", F.lit(k).alias("folds"))


@query("m13_d8_importance_values")
def m13_values(spark, sf):
    """The ten features that the full forest of random cuts rests on most, with their shares."""
    rows, names = session_rows(spark, sf)
    forest = xt.fit_extra_trees(train_of(rows), COLUMNS, len(names), trees=100)
    found = spark.createDataFrame(list(forest.importances().items()), "feature string, importance double")
    return tab.top_n(found, "importance", 10, "feature")


@query("m14_e11_model_scores")
def m14_scores(spark, sf):
    """Scores of the models on the test sessions at their usual settings; one that cannot be fitted is reported."""
    rows, names = scaled_sessions(spark, sf)
    train, test = train_of(rows), rows.filter("split = 'test'")
    weighted = with_class_weight(train)
    fits = {
        "extra_trees": lambda: xt.fit_extra_trees(weighted, COLUMNS, len(names), weight="weight", trees=100),
        "boosting": lambda: bo.fit_boosted(weighted, COLUMNS, len(names), weight="weight"),
        "broken": lambda: bo.fit_boosted(weighted.limit(0), COLUMNS, len(names)),
    }
    parts, status = [], []
    for name, fit in fits.items():
        try:
            shown = training.named_predictions(fit().predict(test), names)
        except ValueError as problem:
            status.append((name, f"failed: {problem}"))
            continue
        status.append((name, "fitted"))
        parts.append(shown.select(*KEYS, F.lit(name).alias("model"), F.col("label").alias("y_true"), F.col("pred_label").alias("y_pred")))
    ready = training.assemble(rows, COLUMNS)
    linear = training.logistic_regression(train.count()).fit(train_of(ready))
    status.append(("logistic", "fitted"))
    shown = training.predictions(linear, ready.filter("split = 'test'"), names)
    parts.append(shown.select(*KEYS, F.lit("logistic").alias("model"), F.col("label").alias("y_true"), F.col("pred_label").alias("y_pred")))
    scores = training.compare_models(materialize(reduce(lambda a, b: a.unionByName(b), parts), "predicted"))
    return spark.createDataFrame(status, "model string, status string").join(scores, "model", "left")


# --- J10: approximate neighbours -----------------------------------------------------------------------------------


def _near_both(spark, sf):
    rows = materialize(near_sessions(spark, sf), "scaled")
    test, train = rows.filter("split = 'test'"), train_of(rows)
    return approximate_neighbours(test, train, NEAR_COLUMNS), nearest_neighbours(test, train, NEAR_COLUMNS)


@query(
    "j10_approximate_recall",
    with_tables("SELECT CAST(count(*) AS BIGINT) AS wanted, TRUE AS recall_of_nine_tenths FROM ranked", "snaps", "true_labels", extra=NEAR_SQL),
)
def j10_recall(spark, sf):
    """Neighbours by random-projection buckets against the exact ones."""
    near, true = _near_both(spark, sf)
    return recall(near, true).select("wanted", (F.col("recall") >= 0.9).alias("recall_of_nine_tenths"))


@query("j10_approximate_neighbours")
def j10_approximate(spark, sf):
    rows = materialize(near_sessions(spark, sf), "scaled")
    return approximate_neighbours(rows.filter("split = 'test'"), train_of(rows), NEAR_COLUMNS)
