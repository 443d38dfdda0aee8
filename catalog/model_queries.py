"""Splits, preparation, vectors, neighbours, models and evaluation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from catalog.inputs import labels, predictions, session_table, snapshots, with_tables
from catalog.registry import query, r, rounded, sr
from catalog.session_queries import EVENT, LABELLED
from snapweave.functions.vectors import clean_embedding, finite_or_null
from snapweave.operators import aggregates as agg
from snapweave.operators import evaluation as ev
from snapweave.operators import prep, splits
from snapweave.operators import tables as tab
from snapweave.operators.neighbours import nearest_neighbours, vote
from snapweave.plans import boosting, extra_trees, kernel, training
from snapweave.runtime import materialize, scratch_path
from snapweave.schema import HUMAN_NAMES, KEYS, LABEL_NAMES

IN_TEST = "substr(md5('42:' || user_id), 1, 8) < '33333333'"
IN_VAL = "substr(md5('42:val:' || user_id), 1, 8) < '33333333'"
SPLIT = f"CASE WHEN {IN_TEST} THEN 'test' ELSE 'train' END"
SPLIT3 = f"CASE WHEN {IN_TEST} THEN 'test' WHEN {IN_VAL} THEN 'validation' ELSE 'train' END"
SNAP_SPLIT = {"rows": f"SELECT *, {SPLIT} AS split FROM snaps", "train": "SELECT * FROM rows WHERE split = 'train'"}


def split_rows(spark, sf, **options):
    return splits.split_by_user(snapshots(spark, sf, **({"chars": False} | options)))


def train_of(df):
    return df.filter("split = 'train'")


# --- splits ------------------------------------------------------------------------------------------


@query("g1_split_by_user", with_tables(f"SELECT event_id, user_id, exercise_id, {SPLIT} AS split FROM snaps", "snaps"))
def g1(spark, sf):
    return split_rows(spark, sf).select(*EVENT, "split")


@query(
    "g1_split_by_user_exact",
    with_tables(
        """SELECT event_id, s.user_id, exercise_id, CASE WHEN pos <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split
           FROM snaps s JOIN users USING (user_id)""",
        "snaps",
        extra={
            "users": """SELECT user_id, row_number() OVER (ORDER BY md5('42:' || user_id), user_id) AS pos, count(*) OVER () AS n
                        FROM (SELECT DISTINCT user_id FROM snaps)"""
        },
    ),
)
def g1_exact(spark, sf):
    return splits.split_by_user(snapshots(spark, sf, chars=False), exact=True).select(*EVENT, "split")


@query(
    "g2_split_by_list",
    with_tables(
        """SELECT user_id, exercise_id, CASE WHEN user_id IN ('Student_10', 'Student_8', 'Student_13', 'Student_11')
                  THEN 'test' ELSE 'train' END AS split FROM true_labels""",
        "true_labels",
    ),
)
def g2(spark, sf):
    users = ["Student_10", "Student_8", "Student_13", "Student_11"]
    return splits.split_by_list(labels(spark, sf), users).select(*KEYS, "split")


@query("g3_validation_by_user", with_tables(f"SELECT user_id, exercise_id, {SPLIT3} AS split FROM true_labels", "true_labels"))
def g3(spark, sf):
    return splits.with_validation(splits.split_by_user(labels(spark, sf))).select(*KEYS, "split")


@query(
    "g4_stratified_validation",
    with_tables(
        f"""SELECT user_id, exercise_id, CASE WHEN split = 'train' AND place <= round(0.2 * n) THEN 'validation' ELSE split END AS split
            FROM (SELECT *, row_number() OVER (PARTITION BY label, split
                        ORDER BY md5('42:strat:' || user_id || ':' || exercise_id), user_id, exercise_id) AS place,
                    count(*) OVER (PARTITION BY label, split) AS n
                  FROM (SELECT *, {SPLIT} AS split FROM true_labels))""",
        "true_labels",
    ),
)
def g4(spark, sf):
    return splits.stratified_validation(splits.split_by_user(labels(spark, sf))).select(*KEYS, "split")


@query(
    "g5_tail_validation",
    with_tables(
        f"""SELECT user_id, exercise_id, CASE WHEN split = 'train' AND place > floor(0.85 * n) THEN 'validation' ELSE split END AS split
            FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY user_id, exercise_id) AS place,
                    count(*) OVER (PARTITION BY split) AS n FROM (SELECT *, {SPLIT} AS split FROM true_labels))""",
        "true_labels",
    ),
)
def g5(spark, sf):
    return splits.tail_validation(splits.split_by_user(labels(spark, sf))).select(*KEYS, "split")


@query(
    "g6_user_folds",
    with_tables(
        """SELECT user_id, exercise_id,
             CAST(('0x' || substr(md5('42:fold:' || user_id), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM true_labels""",
        "true_labels",
    ),
)
def g6(spark, sf):
    return splits.user_folds(labels(spark, sf)).select(*KEYS, "fold")


@query(
    "g6_balanced_user_folds",
    with_tables(
        """SELECT user_id, n AS snapshots,
             CAST(CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS INTEGER) AS fold
           FROM (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS pos
                 FROM snaps GROUP BY user_id)""",
        "snaps",
    ),
)
def g6_balanced(spark, sf):
    folds = splits.balanced_user_folds(snapshots(spark, sf, chars=False))
    return folds.groupBy("user_id").agg(F.count(F.lit(1)).alias("snapshots"), F.max("fold").alias("fold"))


# --- preparation ---------------------------------------------------------------------------------------

GAPPY = ["task_code_cosine", "sparse_metric"]


@query(
    "f1_train_mean_fill",
    with_tables(
        "SELECT event_id, user_id, exercise_id, "
        + ", ".join(sr(f"coalesce({c}, (SELECT avg({c}) FROM train))", c) for c in GAPPY)
        + " FROM rows",
        "snaps", extra=SNAP_SPLIT,
    ),
)
def f1(spark, sf):
    rows = split_rows(spark, sf)
    return rounded(prep.fit_mean_fill(train_of(rows), GAPPY).apply(rows).select(*EVENT, *GAPPY))


@query(
    "f2_train_median_fill",
    with_tables(
        "SELECT event_id, user_id, exercise_id, "
        + ", ".join(sr(f"coalesce({c}, (SELECT median({c}) FROM train))", c) for c in GAPPY)
        + " FROM rows",
        "snaps", extra=SNAP_SPLIT,
    ),
)
def f2(spark, sf):
    rows = split_rows(spark, sf)
    return rounded(prep.fit_median_fill(train_of(rows), GAPPY).apply(rows).select(*EVENT, *GAPPY))


@query(
    "f5_fill_unknown",
    with_tables(
        """SELECT event_id, s.user_id, s.exercise_id, coalesce(level, 'UNK') AS level
           FROM snaps s LEFT JOIN (SELECT * FROM session_table WHERE row_no = 1) t USING (user_id, exercise_id)""",
        "snaps", "session_table",
    ),
)
def f5(spark, sf):
    unique = tab.keep_first(session_table(spark, sf), KEYS, ["row_no"]).select(*KEYS, "level")
    return prep.fill_unknown(tab.attach(snapshots(spark, sf, chars=False), unique), ["level"]).select(*EVENT, "level")


PROFILED = ["seconds_from_start", "task_code_cosine", "sparse_metric", "min_interval_seconds", "submits_before_snapshot"]
TEXTS = ["exercise_type", "event_type", "session_id", "same_text"]


def with_deviation(profile):
    """Variances of clock columns have more digits than a double keeps, so their roots are compared."""
    return profile.withColumn("deviation", F.sqrt("variance")).drop("variance")


def _profile_sql() -> str:
    numeric = [
        f"""SELECT '{c}' AS feature, 'numeric' AS kind, {sr(f'avg(({c} IS NULL)::INT)', 'missing_rate')},
              {sr(f'stddev_samp({c})', 'deviation')}, CAST(NULL AS BIGINT) AS n_distinct,
              CASE WHEN avg(({c} IS NULL)::INT) > 0.25 THEN 'missing' WHEN var_samp({c}) < 1e-4 THEN 'low_variance'
                   ELSE 'kept' END AS status FROM train"""
        for c in PROFILED
    ]
    texts = [
        f"""SELECT '{c}', 'categorical', {sr(f'avg(({c} IS NULL)::INT)')}, NULL, count(DISTINCT {c}),
              CASE WHEN avg(({c} IS NULL)::INT) > 0.25 THEN 'missing'
                   WHEN count(DISTINCT {c}) NOT BETWEEN 2 AND 20 THEN 'cardinality' ELSE 'kept' END FROM train"""
        for c in TEXTS
    ]
    extra = {"rows": f"SELECT *, 'same' AS same_text, {SPLIT} AS split FROM snaps", "train": SNAP_SPLIT["train"]}
    return with_tables(" UNION ALL ".join(numeric + texts), "snaps", extra=extra)


@query("f6_f7_f8_choose_snapshot_columns", _profile_sql())
def f6(spark, sf):
    train = train_of(split_rows(spark, sf)).withColumn("same_text", F.lit("same"))
    return rounded(with_deviation(prep.choose_snapshot_columns(train, PROFILED, TEXTS).report))


def _session_choice_sql() -> str:
    parts = [
        f"""SELECT '{c}' AS feature, 'numeric' AS kind, {sr(f'avg(({c} IS NULL)::INT)', 'missing_rate')},
              {sr(f'sqrt(CASE WHEN avg(({c} IS NULL)::INT) <= 0.25 THEN var_samp(coalesce({c}, (SELECT median({c}) FROM train))) ELSE var_samp({c}) END)', 'deviation')},
              CASE WHEN avg(({c} IS NULL)::INT) > 0.25 THEN 'missing'
                   WHEN var_samp(coalesce({c}, (SELECT median({c}) FROM train))) <= 1e-5 THEN 'low_variance'
                   ELSE 'kept' END AS status FROM train"""
        for c in PROFILED
    ]
    return with_tables(" UNION ALL ".join(parts), "snaps", extra=SNAP_SPLIT)


@query("f6_f7_choose_session_columns", _session_choice_sql())
def f7(spark, sf):
    train = train_of(split_rows(spark, sf))
    return rounded(with_deviation(prep.choose_session_columns(train, PROFILED).report.drop("n_distinct")))


def _edges(c: str) -> str:
    cuts = ", ".join(f"{i / 10}" for i in range(1, 10))
    return f"SELECT DISTINCT unnest(quantile_cont({c}, [{cuts}])) AS e FROM train"


INFORMATIVE = ["seconds_from_start", "executes_before_snapshot", "task_code_cosine"]
CELLS = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, bin, label, count(*) AS n FROM
          (SELECT label, CASE WHEN {c} IS NOT NULL THEN (SELECT count(*) FROM ({_edges(c)}) WHERE e < t.{c}) END AS bin FROM train t)
        GROUP BY bin, label"""
    for c in INFORMATIVE
)
LABELLED_TRAIN = {
    "labelled": LABELLED,
    "train": f"SELECT * FROM labelled WHERE label IS NOT NULL AND NOT ({IN_TEST})",
}


def labelled_train(spark, sf):
    rows = tab.attach(snapshots(spark, sf, chars=False), labels(spark, sf))
    return train_of(splits.split_by_user(tab.drop_unlabelled(rows)))


@query(
    "f10_mutual_information",
    with_tables(
        f"""SELECT feature, {sr('sum(n / total * ln(n * total / (by_bin * by_label)))', 'mi')} FROM
              (SELECT feature, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS total,
                 CAST(sum(n) OVER (PARTITION BY feature, bin) AS DOUBLE) AS by_bin,
                 CAST(sum(n) OVER (PARTITION BY feature, label) AS DOUBLE) AS by_label FROM cells)
            GROUP BY feature""",
        "snaps", "true_labels", extra=LABELLED_TRAIN | {"cells": CELLS},
    ),
)
def f10(spark, sf):
    train = labelled_train(spark, sf)
    edges = prep.quantile_edges(train, INFORMATIVE)
    return rounded(prep.mutual_information(prep.binned_labels(train, edges, INFORMATIVE)))


@query(
    "f11_label_codes",
    with_tables(
        "SELECT user_id, exercise_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_index FROM true_labels",
        "true_labels",
    ),
)
def f11(spark, sf):
    rows = labels(spark, sf)
    return prep.encode_labels(rows, prep.label_codes(rows)).select(*KEYS, "label", "label_index")


@query(
    "f12_one_hot",
    with_tables(
        """SELECT user_id, exercise_id, row_no, (level = 'easy')::DOUBLE AS c0, (level = 'hard')::DOUBLE AS c1,
                  (level = 'medium')::DOUBLE AS c2 FROM session_table""",
        "session_table",
    ),
)
def f12(spark, sf):
    rows = splits.split_by_user(session_table(spark, sf))
    encoded = training.one_hot(train_of(rows), ["level"]).transform(rows)
    cells = vector_to_array("level_onehot")
    return encoded.select(*KEYS, "row_no", *[cells[i].alias(f"c{i}") for i in range(3)])


SCALED = ["seconds_from_start", "executes_before_snapshot", "min_interval_seconds"]


@query(
    "f13_standardise",
    with_tables(
        "SELECT event_id, user_id, exercise_id, "
        + ", ".join(
            sr(f"({c} - (SELECT avg({c}) FROM train)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM train)", c)
            for c in SCALED
        )
        + " FROM rows",
        "snaps", extra=SNAP_SPLIT,
    ),
)
def f13(spark, sf):
    rows = split_rows(spark, sf)
    return rounded(prep.fit_scaler(train_of(rows), SCALED).apply(rows).select(*EVENT, *SCALED))


def with_pca(spark, sf, components=16):
    rows = splits.split_by_user(snapshots(spark, sf, chars=False, embeddings=True))
    dim = agg.embedding_dim(rows, "code_embedding", ["event_id"]).first()["dim"]
    model = training.fit_embedding_pca(train_of(rows), "code_embedding", dim, components)
    return training.apply_embedding_pca(rows, "code_embedding", dim, model)


@query(
    "f14_embedding_pca",
    "SELECT range AS component, TRUE AS centred, TRUE AS uncorrelated, TRUE AS falling FROM range(1, 17)",
)
def f14(spark, sf):
    """What principal components of the training rows must hold: mean 0, no covariance, falling spread."""
    names = [f"pc{i + 1}" for i in range(16)]
    rows = train_of(with_pca(spark, sf)).select(*[F.col("code_embedding_pca")[i].alias(c) for i, c in enumerate(names)])
    found = rows.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in names],
        *[F.var_pop(c).alias(f"var_{c}") for c in names],
        *[F.max(F.abs(F.col(c))).alias(f"top_{c}") for c in names],
        *[F.covar_pop(a, b).alias(f"cov_{a}_{b}") for i, a in enumerate(names) for b in names[:i]],
    )
    entries = []
    for i, c in enumerate(names):
        apart = [F.abs(F.col(f"cov_{c}_{b}")) < 1e-6 for b in names[:i]] or [F.lit(True)]
        entries.append(
            F.struct(
                F.lit(i + 1).cast("long").alias("component"),
                (F.abs(F.col(f"mean_{c}")) < 1e-6).alias("centred"),
                F.forall(F.array(*apart), lambda x: x).alias("uncorrelated"),
                (F.col(f"var_{c}") <= (F.col(f"var_{names[i - 1]}") + 1e-9 if i else F.lit(1e300))).alias("falling"),
            )
        )
    return found.select(F.inline(F.array(*entries)))


@query(
    "f15_assembled_vectors",
    with_tables(
        f"""SELECT event_id, user_id, exercise_id, {{n}} + 4 + (SELECT count(DISTINCT exercise_type) FROM snaps WHERE NOT ({IN_TEST})) AS width,
              TRUE AS train_mean_is_zero FROM snaps""".replace("{n}", str(len(SCALED))),
        "snaps",
    ),
)
def f15(spark, sf):
    """Numbers, PCA and one-hot parts in one vector that is scaled as a whole on the training rows."""
    rows = with_pca(spark, sf, 4)
    rows = training.one_hot(train_of(rows), ["exercise_type"]).transform(rows)
    parts = [f"pc{i}" for i in range(4)]
    rows = rows.withColumns({p: F.col("code_embedding_pca")[i] for i, p in enumerate(parts)})
    vectors = training.assemble(rows, [*SCALED, *parts, "exercise_type_onehot"])
    scaled = training.scale_vectors(train_of(vectors), "features").transform(vectors)
    values = scaled.withColumn("v", vector_to_array("features_scaled"))
    mean = train_of(values).select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).agg(F.max(F.abs(F.col("m"))).alias("worst"))
    return values.crossJoin(F.broadcast(mean)).select(
        *EVENT, F.size("v").cast("long").alias("width"), (F.col("worst") < 1e-6).alias("train_mean_is_zero")
    )


SEQUENCE = ["seconds_from_start", "executes_before_snapshot"]
MAXLEN = {
    "lengths": f"SELECT user_id, exercise_id, count(*) AS n FROM snaps GROUP BY ALL",
    "maxlen": f"SELECT greatest(2, CAST(floor(quantile_cont(n, 0.9)) AS INTEGER)) AS m FROM lengths WHERE NOT ({IN_TEST})",
}


@query(
    "a22_padding_length",
    with_tables(
        f"""SELECT (SELECT m FROM maxlen) AS p90,
              greatest(2, CAST(floor(quantile_cont(n, 0.95)) AS INTEGER)) AS p95 FROM lengths WHERE NOT ({IN_TEST})""",
        "snaps", extra=MAXLEN,
    ),
)
def a22(spark, sf):
    sessions = agg.session_meta(split_rows(spark, sf), ["snapshot_sequence_num"], ["split"])
    lengths = train_of(sessions)
    p90, p95 = (agg.length_percentile(lengths, p).scalar() for p in (0.9, 0.95))
    return spark.range(0, 1, 1, 1).select(p90.alias("p90"), p95.alias("p95"))


@query(
    "f16_padded_sequences",
    with_tables(
        f"""SELECT l.user_id, l.exercise_id, CAST(g.k AS INTEGER) AS step,
              {sr('coalesce(p.seconds_from_start, 0)', 'v0')}, {sr('coalesce(p.executes_before_snapshot, 0)', 'v1')}
            FROM lengths l, range((SELECT m FROM maxlen)) g(k) LEFT JOIN placed p
              ON p.user_id = l.user_id AND p.exercise_id = l.exercise_id AND p.pos = g.k""",
        "snaps",
        extra=MAXLEN
        | {"placed": "SELECT *, row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY snapshot_sequence_num) - 1 AS pos FROM snaps"},
    ),
)
def f16(spark, sf):
    rows = split_rows(spark, sf)
    lengths = train_of(agg.session_meta(rows, ["snapshot_sequence_num"], ["split"]))
    maxlen = agg.length_percentile(lengths, 0.9).first()["maxlen"]
    padded = prep.padded_sequences(rows, SEQUENCE, maxlen)
    steps = padded.select(*KEYS, F.posexplode("sequence").alias("step", "v"))
    return rounded(steps.select(*KEYS, "step", *[F.col("v")[i].alias(f"v{i}") for i in range(2)]))


@query(
    "f17_sample_weights",
    with_tables(
        f"""SELECT user_id, exercise_id, label, {sr('w', 'weight')} FROM true_labels JOIN
              (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM true_labels GROUP BY label) USING (label)""",
        "true_labels",
    ),
)
def f17(spark, sf):
    return rounded(agg.with_class_weight(labels(spark, sf)).select(*KEYS, "label", "weight"))


@query(
    "s14_clean_embeddings",
    with_tables(
        f"""SELECT event_id, user_id, exercise_id, CAST(64 AS INTEGER) AS dim,
              {sr('coalesce(list_sum(code_embedding::DOUBLE[]), 0)', 'total', 3)},
              {sr('coalesce((SELECT sum(v * i) FROM (SELECT unnest(code_embedding::DOUBLE[]) AS v, generate_subscripts(code_embedding, 1) AS i)), 0)', 'weighted', 3)}
            FROM embedded""",
        "embedded",
    ),
)
def s14(spark, sf):
    rows = snapshots(spark, sf, chars=False, embeddings=True)
    clean = rows.select(*EVENT, clean_embedding(F.col("code_embedding"), 64).alias("e"))
    zero, add = F.lit(0.0), lambda a, v: a + v
    return clean.select(
        *EVENT,
        F.size("e").alias("dim"),
        r(F.aggregate("e", zero, add), 3).alias("total"),
        r(F.aggregate(F.transform("e", lambda v, i: v * (i + 1)), zero, add), 3).alias("weighted"),
    )


@query(
    "s15_embedding_dim",
    with_tables("SELECT CAST(len(arg_min(code_embedding, event_id) FILTER (WHERE len(code_embedding) > 0)) AS INTEGER) AS dim FROM embedded", "embedded"),
)
def s15(spark, sf):
    return agg.embedding_dim(snapshots(spark, sf, chars=False, embeddings=True), "code_embedding", ["event_id"])


@query(
    "s16_finite_values",
    f"SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN {sr('value')} END AS value FROM events",
)
def s16(spark, sf):
    bad = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("event_type") == "signup", F.lit(float("-inf")))
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.coalesce(bad, "value").alias("v"))
    return rounded(rows.select("event_id", finite_or_null(F.col("v")).alias("value")))


@query(
    "a19_a20_a21_column_profile",
    with_tables(
        " UNION ALL ".join(
            [
                f"SELECT '{c}' AS feature, {sr(f'avg(({c} IS NULL)::INT)', 'missing_rate')}, {sr(f'stddev_samp({c})', 'deviation')}, CAST(NULL AS BIGINT) AS n_distinct FROM train"
                for c in PROFILED
            ]
            + [f"SELECT '{c}', {sr(f'avg(({c} IS NULL)::INT)')}, NULL, count(DISTINCT {c}) FROM train" for c in TEXTS[:3]]
        ),
        "snaps", extra=SNAP_SPLIT,
    ),
)
def a19(spark, sf):
    profile = agg.column_profile(train_of(split_rows(spark, sf)), PROFILED, TEXTS[:3])
    return rounded(with_deviation(profile.drop("kind")))


@query(
    "a26_dataset_summary",
    with_tables(
        f"""SELECT split, count(*) AS snapshots, count(DISTINCT (user_id, exercise_id)) AS sessions, count(DISTINCT user_id) AS users
            FROM rows GROUP BY split""",
        "snaps", extra=SNAP_SPLIT,
    ),
)
def a26(spark, sf):
    sessions = agg.session_meta(split_rows(spark, sf), ["snapshot_sequence_num"], ["split"])
    return sessions.groupBy("split").agg(
        F.sum("seq_len").alias("snapshots"), F.count(F.lit(1)).alias("sessions"), F.count_distinct("user_id").alias("users")
    )


# --- neighbours and models ---------------------------------------------------------------------------------

NEAR = ["executes_before_snapshot", "ai_feedback_before_snapshot", "keystrokes_before_snapshot", "task_code_cosine"]
NEAR_COLUMNS = [f"{c}_{s}" for c in NEAR for s in ("mean", "std")]
NEAR_SQL = {
    "labelled": "SELECT s.user_id, s.exercise_id, l.label, "
    + ", ".join(f"coalesce({c}, avg({c}) OVER (PARTITION BY s.user_id, s.exercise_id)) AS {c}" for c in NEAR)
    + " FROM snaps s LEFT JOIN true_labels l USING (user_id, exercise_id)",
    "wide": "SELECT user_id, exercise_id, label, "
    + ", ".join(f"coalesce(avg({c}), 0) AS {c}_mean, coalesce(stddev_pop({c}), 0) AS {c}_std" for c in NEAR)
    + " FROM labelled WHERE label IS NOT NULL GROUP BY user_id, exercise_id, label",
    "train0": f"SELECT * FROM wide WHERE NOT ({IN_TEST})",
    "scaled": "SELECT user_id, exercise_id, label, "
    + ", ".join(f"({c} - (SELECT avg({c}) FROM train0)) / (SELECT stddev_pop({c}) FROM train0) AS {c}" for c in NEAR_COLUMNS)
    + " FROM wide",
    "ranked": "SELECT t.user_id || '|' || t.exercise_id AS session, n.user_id || '|' || n.exercise_id AS neighbour, n.label, sqrt("
    + " + ".join(f"(t.{c} - n.{c}) ** 2" for c in NEAR_COLUMNS)
    + f""") AS distance, row_number() OVER (PARTITION BY t.user_id, t.exercise_id
            ORDER BY {' + '.join(f'(t.{c} - n.{c}) ** 2' for c in NEAR_COLUMNS)}, n.user_id || '|' || n.exercise_id) AS rank
          FROM scaled t, scaled n WHERE {IN_TEST.replace('user_id', 't.user_id')} AND NOT ({IN_TEST.replace('user_id', 'n.user_id')})
          QUALIFY rank <= 5""",
}


def scaled_sessions(spark, sf, features=NEAR, columns=NEAR_COLUMNS):
    snaps = snapshots(spark, sf, chars=False)
    rows = tab.drop_unlabelled(tab.attach(snaps, labels(spark, sf)))
    wide = splits.split_by_user(agg.session_features(rows, features, carry=["label"], counted=snaps))
    wide = wide.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})
    return prep.fit_scaler(train_of(wide), columns).apply(wide).select(*KEYS, "label", "split", *columns)


def neighbours_of_test(spark, sf):
    rows = materialize(scaled_sessions(spark, sf), "scaled")
    return nearest_neighbours(rows.filter("split = 'test'"), train_of(rows), NEAR_COLUMNS)


@query(
    "j10_nearest_neighbours",
    with_tables(f"SELECT session, rank, neighbour, label, {sr('distance', 'distance')} FROM ranked", "snaps", "true_labels", extra=NEAR_SQL),
)
def j10(spark, sf):
    return rounded(neighbours_of_test(spark, sf))


@query(
    "m6_neighbour_vote",
    with_tables(
        """SELECT session, arg_min(label, (-votes, label)) AS pred_label, max(votes) AS votes FROM
             (SELECT session, label, count(*) AS votes FROM ranked GROUP BY session, label) GROUP BY session""",
        "snaps", "true_labels", extra=NEAR_SQL,
    ),
)
def m6(spark, sf):
    return vote(neighbours_of_test(spark, sf))


MODEL_FEATURES = ["seconds_from_start", "keystrokes_before_snapshot", "executes_before_snapshot", "task_code_cosine"]


def model_frame(spark, sf):
    """Filled, scaled and indexed session rows, written once: every model below reads them."""
    snaps = snapshots(spark, sf, chars=False)
    rows = tab.drop_unlabelled(tab.attach(snaps, labels(spark, sf)))
    wide = splits.split_by_user(agg.session_features(rows, MODEL_FEATURES, carry=["label"], counted=snaps))
    wide = materialize(splits.user_folds(wide), "wide")
    train = train_of(wide)
    choice = prep.choose_session_columns(train, prep.numeric_columns(wide))
    filled = choice.fill.apply(wide)
    scaled = prep.fit_scaler(train_of(filled), choice.kept).apply(filled)
    indexer = training.label_indexer(train)
    ready = agg.with_class_weight(train_of(scaled)).unionByName(
        scaled.filter("split = 'test'").withColumn("weight", F.lit(1.0))
    )
    frame = materialize(indexer.transform(training.assemble(ready, choice.kept)), "frame")
    return frame, indexer.labels, choice.kept


TEST_SESSIONS = (
    "SELECT DISTINCT s.user_id, s.exercise_id, label, TRUE AS known_label{more} FROM snaps s "
    f"JOIN true_labels USING (user_id, exercise_id) WHERE label IS NOT NULL AND {IN_TEST.replace('user_id', 's.user_id')}"
)


def test_sessions_sql(**columns: str) -> str:
    """One row per test session and, for what a model must hold whatever it learned, the value it must have."""
    more = "".join(f", {value} AS {name}" for name, value in columns.items())
    return with_tables(TEST_SESSIONS.format(more=more), "snaps", "true_labels")


def checked(scored, names):
    """Every test session with whether its predicted label is one of the known ones and its probabilities sum to 1."""
    shown = [F.col(c) for c in scored.columns if c.startswith("proba_")]
    total = sum(shown[1:], shown[0]) if shown else F.lit(1.0)
    fair = F.abs(total - 1) < 1e-6
    return scored.select(*KEYS, "label", F.col("pred_label").isin(names).alias("known_label"), fair.alias("sums_to_one"))


def _outcome(build):
    def run(spark, sf):
        frame, names, _ = model_frame(spark, sf)
        train, test = train_of(frame), frame.filter("split = 'test'")
        return checked(training.predictions(build(train, names).fit(train), test, names), names)

    return run


def _fitted(fit):
    """The same for models that are fitted on named columns."""

    def run(spark, sf):
        frame, names, columns = model_frame(spark, sf)
        model = fit(train_of(frame), columns, len(names))
        return checked(training.named_predictions(model.predict(frame.filter("split = 'test'")), names), names)

    return run


def _kernel_svm(spark, sf):
    frame, names, columns = model_frame(spark, sf)
    train = train_of(frame)
    features = kernel.FourierFeatures(tuple(columns), kernel.scale_gamma(train, columns))
    ready, n = kernel.with_kernel_vector(frame, features), train.count()
    fitted = kernel.fit_by_class(kernel.rbf_svm(n, parallelism=4), train_of(ready), n, features.size)
    return checked(training.predictions(fitted, ready.filter("split = 'test'"), names), names)


OUTCOME_SQL = test_sessions_sql(sums_to_one="TRUE")


query("m1_random_forest", OUTCOME_SQL)(_fitted(lambda train, columns, n: extra_trees.fit_random_forest(train, columns, n)))
query("m2_weighted_random_forest", OUTCOME_SQL)(_outcome(lambda train, names: training.random_forest(100, weight="weight", maxDepth=12)))
query("m3_extra_trees", OUTCOME_SQL)(_fitted(lambda train, columns, n: extra_trees.fit_extra_trees(train, columns, n, weight="weight")))
query("m4_boosted_trees", OUTCOME_SQL)(_fitted(lambda train, columns, n: boosting.fit_boosted(train, columns, n, weight="weight")))
query("m5_linear_svm", OUTCOME_SQL)(_kernel_svm)
query("m7_m11_logistic_regression", OUTCOME_SQL)(_outcome(lambda train, names: training.logistic_regression(train.count())))


@query("m8_sequence_classifier", test_sessions_sql())
def m8(spark, sf):
    rows = tab.drop_unlabelled(tab.attach(snapshots(spark, sf, chars=False), labels(spark, sf)))
    rows = splits.split_by_user(rows)
    rows = prep.fit_mean_fill(train_of(rows), MODEL_FEATURES).apply(rows)
    rows = prep.fit_scaler(train_of(rows), MODEL_FEATURES).apply(rows)
    lengths = train_of(agg.session_meta(rows, ["snapshot_sequence_num"], ["split"]))
    maxlen = agg.length_percentile(lengths, 0.9).first()["maxlen"]
    padded = prep.padded_sequences(rows, MODEL_FEATURES, maxlen, carry=["label", "split"])
    frame = materialize(training.flatten_sequences(padded).drop("sequence"), "sequences")
    train = train_of(frame)
    indexer = training.label_indexer(train)
    weighted = training.balanced_resample(agg.with_class_weight(indexer.transform(train)))
    model = training.sequence_perceptron(maxlen * len(MODEL_FEATURES), len(indexer.labels)).fit(weighted)
    scored = training.predictions(model, frame.filter("split = 'test'"), indexer.labels)
    return checked(scored, indexer.labels).drop("sums_to_one")


@query("m9_m10_grouped_search", test_sessions_sql(best_of_tried="TRUE"))
def m9(spark, sf):
    frame, names, columns = model_frame(spark, sf)
    train = train_of(frame).drop("features")
    pipeline = training.model_pipeline(training.random_forest(10, maxDepth=5), columns)
    step, _, forest = pipeline.getStages()
    space = {step.k: [20, len(columns)], forest.maxDepth: [4, 8]}
    search = training.grouped_search(train, pipeline, space, n=2, parallelism=4)
    best = training.predictions(search.bestModel, frame.filter("split = 'test'").drop("features"), names)
    scores = [float(m) for m in search.avgMetrics]
    refitted = search.bestModel.stages[-1].getNumTrees == 10 and 0 <= min(scores) <= max(scores) <= 1
    return checked(best, names).drop("sums_to_one").withColumn("best_of_tried", F.lit(refitted))


@query("m13_d8_importances", "SELECT range AS place, TRUE AS known, TRUE AS falling, TRUE AS sums_to_one FROM range(1, 11)")
def m13(spark, sf):
    frame, _, columns = model_frame(spark, sf)
    model = training.random_forest(100, maxDepth=12).fit(train_of(frame))
    every = training.importances(spark, model, columns, len(columns))
    ranked = every.withColumns(
        {
            "place": F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).cast("long"),
            "total": F.sum("importance").over(Window.partitionBy()),
        }
    )
    top = training.importances(spark, model, columns, 10).select("feature", F.col("importance").alias("shown"))
    least = ranked.filter("place = 10").select(F.col("importance").alias("tenth"))
    return ranked.join(top, "feature").crossJoin(F.broadcast(least)).select(
        "place",
        F.col("feature").isin(columns).alias("known"),
        ((F.col("shown") == F.col("importance")) & (F.col("shown") >= F.col("tenth"))).alias("falling"),
        (F.abs(F.col("total") - 1) < 1e-6).alias("sums_to_one"),
    )


@query(
    "m14_e11_compare_models",
    "SELECT * FROM (VALUES ('forest', 'fitted', TRUE), ('logistic', 'fitted', TRUE), ('broken', 'failed', NULL)) t(model, status, scores_in_range)",
)
def m14(spark, sf):
    frame, names, _ = model_frame(spark, sf)
    train, test = train_of(frame), frame.filter("split = 'test'")
    models = {
        "forest": training.random_forest(20, maxDepth=8),
        "logistic": training.logistic_regression(train.count(), 100),
        "broken": training.sequence_perceptron(3, 2),
    }
    outcomes = training.fit_all(train, models)
    scores = training.compare_models(training.all_predictions(outcomes, test, names))
    status = training.status_table(spark, outcomes)
    status = status.withColumn("status", F.when(F.col("status").startswith("failed"), "failed").otherwise("fitted"))
    numbers = [f.name for f in scores.schema.fields if f.dataType.typeName() == "double"]
    fair = F.least(*numbers) >= 0, F.greatest(*numbers) <= 1
    return status.join(scores, "model", "left").select("model", "status", (fair[0] & fair[1]).alias("scores_in_range"))


@query("io10_model_sink", test_sessions_sql(same_after_loading="TRUE"))
def io10(spark, sf):
    frame, names, columns = model_frame(spark, sf)
    pipeline = training.model_pipeline(training.random_forest(10, maxDepth=5), columns, k=20)
    path = scratch_path(spark, "model")
    fitted = pipeline.fit(train_of(frame).drop("features"))
    training.save_model(fitted, path)
    test = frame.filter("split = 'test'").drop("features")
    before = training.predictions(fitted, test, names).select(*KEYS, F.col("pred_label").alias("was"))
    after = checked(training.predictions(training.PipelineModel.load(path), test, names).join(before, KEYS), names)
    same = training.predictions(training.PipelineModel.load(path), test, names).join(before, KEYS)
    return after.drop("sums_to_one").join(
        same.select(*KEYS, (F.col("pred_label") == F.col("was")).alias("same_after_loading")), KEYS
    )


# --- evaluation ------------------------------------------------------------------------------------------------

_CASE_TRUE = "CASE trim(label_true) " + " ".join(f"WHEN '{h}' THEN '{n}'" for h, n in zip(HUMAN_NAMES, LABEL_NAMES)) + " ELSE '' END"
_CLEAN = "trim(regexp_replace(regexp_replace(lower(trim(label_pred)), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_')"
_NAME_LIST = ", ".join(f"'{n}'" for n in LABEL_NAMES)
_CASE_PRED = (
    f"CASE WHEN lower(trim(label_pred)) IN ({_NAME_LIST}) THEN lower(trim(label_pred)) WHEN {_CLEAN} IN ({_NAME_LIST}) THEN {_CLEAN} "
    f"WHEN {_CLEAN} = 'aiguided_integrator' THEN 'ai_guided_integrator' WHEN {_CLEAN} = 'debuggercentric_fixer' THEN 'debugger_centric_fixer' "
    f"WHEN {_CLEAN} = 'planthenburst_implementer' THEN 'plan_then_burst_implementer' ELSE '' END"
)
EVAL = {
    "joined": f"""SELECT *, {_CASE_TRUE} AS y_true, {_CASE_PRED} AS y_pred FROM
        (SELECT user_id, exercise_id, model, t.label AS label_true, p.label AS label_pred
         FROM true_labels t JOIN preds p USING (user_id, exercise_id))""",
    "pairs": "SELECT model, y_true, y_pred, count(*) AS n FROM joined WHERE y_true <> '' AND y_pred <> '' GROUP BY ALL",
    "grid": f"SELECT model, unnest([{_NAME_LIST}]) AS label FROM (SELECT DISTINCT model FROM pairs)",
    "counts": """SELECT model, label,
          coalesce((SELECT sum(n) FROM pairs p WHERE p.model = g.model AND p.y_true = g.label AND p.y_pred = g.label), 0) AS tp,
          coalesce((SELECT sum(n) FROM pairs p WHERE p.model = g.model AND p.y_true = g.label), 0) AS t,
          coalesce((SELECT sum(n) FROM pairs p WHERE p.model = g.model AND p.y_pred = g.label), 0) AS p FROM grid g""",
    "scores": """SELECT model, label, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS precision, CASE WHEN t = 0 THEN 0 ELSE tp / t END AS recall,
          CASE WHEN t + p = 0 THEN 0 ELSE 2 * tp / (t + p) END AS f1, CAST(t AS BIGINT) AS support FROM counts""",
}
_METRICS = ("precision", "recall", "f1")


def judged(spark, sf):
    return ev.matched(labels(spark, sf), predictions(spark, sf), test_users=None)


def judged_pairs(spark, sf):
    return ev.mapped(ev.pair_counts(judged(spark, sf)))


def eval_query(name, body):
    return query(name, with_tables(body, "true_labels", "preds", extra=EVAL))


@eval_query("e1_p5_match_counts", "SELECT model, count(*) AS rows_matched, count(*) FILTER (WHERE y_true <> '' AND y_pred <> '') AS rows_mapped FROM joined GROUP BY model")
def e1(spark, sf):
    return ev.match_counts(judged(spark, sf))


@eval_query(
    "e2_unmapped_labels",
    """SELECT 'pred' AS side, model, label_pred AS label, count(*) AS n FROM joined WHERE y_pred = '' GROUP BY ALL
       UNION ALL SELECT 'true', model, label_true, count(*) FROM joined WHERE y_true = '' GROUP BY ALL""",
)
def e2(spark, sf):
    return ev.unmapped_labels(judged(spark, sf))


@eval_query("e3_accuracy", f"SELECT model, {sr('sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n)', 'accuracy')}, CAST(sum(n) AS BIGINT) AS support FROM pairs GROUP BY model")
def e3(spark, sf):
    return rounded(ev.accuracy(judged_pairs(spark, sf)))


@eval_query("e4_macro_scores", "SELECT model, " + ", ".join(sr(f"avg({m})", f"macro_{m}") for m in _METRICS) + " FROM scores GROUP BY model")
def e4(spark, sf):
    return rounded(ev.macro_scores(ev.class_scores(judged_pairs(spark, sf))))


@eval_query("e5_weighted_scores", "SELECT model, " + ", ".join(sr(f"sum({m} * support) / sum(support)", f"weighted_{m}") for m in _METRICS) + " FROM scores GROUP BY model")
def e5(spark, sf):
    return rounded(ev.weighted_scores(ev.class_scores(judged_pairs(spark, sf))))


@eval_query(
    "e6_macro_of_occurring_labels",
    f"""SELECT model, {sr('avg(f1)', 'macro_f1')} FROM
          (SELECT model, label, 2.0 * sum(tp) / sum(c) AS f1 FROM
             (SELECT model, label_true AS label, CASE WHEN label_true = label_pred THEN 1 ELSE 0 END AS tp, 1 AS c FROM raw
              UNION ALL SELECT model, label_pred, 0, 1 FROM raw) GROUP BY model, label) GROUP BY model""".replace(
        "FROM raw", "FROM (SELECT model, y_true AS label_true, coalesce(nullif(y_pred, ''), label_pred) AS label_pred FROM joined)"
    ),
)
def e6(spark, sf):
    rows = judged(spark, sf).withColumn("y_pred", F.coalesce(F.nullif("y_pred", F.lit("")), "label_pred"))
    scores = ev.class_scores(ev.pair_counts(rows), labels=None)
    return rounded(ev.macro_scores(scores).select("model", "macro_f1"))


@eval_query(
    "e7_class_report",
    "SELECT model, label, " + ", ".join(sr(m, m) for m in _METRICS) + ", support FROM scores"
    + f" UNION ALL SELECT model, 'accuracy', NULL, NULL, {sr('sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n)')}, CAST(sum(n) AS BIGINT) FROM pairs GROUP BY model"
    + " UNION ALL SELECT model, 'macro avg', " + ", ".join(sr(f"avg({m})") for m in _METRICS) + ", CAST(sum(support) AS BIGINT) FROM scores GROUP BY model"
    + " UNION ALL SELECT model, 'weighted avg', " + ", ".join(sr(f"sum({m} * support) / sum(support)") for m in _METRICS) + ", CAST(sum(support) AS BIGINT) FROM scores GROUP BY model",
)
def e7(spark, sf):
    return rounded(ev.class_report(judged_pairs(spark, sf)))


@eval_query(
    "e8_confusion_matrix",
    "SELECT g.model, g.label AS y_true, "
    + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE y_pred = '{n}'), 0) AS BIGINT) AS {n}" for n in LABEL_NAMES)
    + " FROM grid g LEFT JOIN pairs p ON p.model = g.model AND p.y_true = g.label GROUP BY ALL",
)
def e8(spark, sf):
    return ev.confusion_matrix(judged_pairs(spark, sf))


@eval_query(
    "e8_confusion_cells",
    """SELECT a.model, a.label AS y_true, b.label AS y_pred, coalesce(n, 0) AS n FROM grid a JOIN grid b ON a.model = b.model
       LEFT JOIN pairs p ON p.model = a.model AND p.y_true = a.label AND p.y_pred = b.label""",
)
def e8_cells(spark, sf):
    return ev.confusion_long(judged_pairs(spark, sf))


@eval_query(
    "e9_j9_coverage",
    """SELECT model, (SELECT count(*) FROM true_labels) AS rows_true, rows_pred, rows_matched,
         (SELECT count(*) FROM true_labels) - rows_matched AS true_only, rows_pred - rows_matched AS pred_only,
         (SELECT count(*) FROM true_labels) - rows_matched AS true_difference, rows_pred - rows_matched AS pred_difference
       FROM (SELECT model, count(*) AS rows_pred FROM preds GROUP BY model)
       JOIN (SELECT model, count(*) AS rows_matched FROM joined GROUP BY model) USING (model)""",
)
def e9(spark, sf):
    return ev.coverage(labels(spark, sf), predictions(spark, sf))


EVALUATED = f"""SELECT model, rows_matched, rows_mapped, accuracy, macro_precision, macro_recall, macro_f1,
         weighted_precision, weighted_recall, weighted_f1 FROM
       (SELECT model, count(*) AS rows_matched, count(*) FILTER (WHERE y_true <> '' AND y_pred <> '') AS rows_mapped FROM joined GROUP BY model)
       JOIN (SELECT model, {sr('sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n)', 'accuracy')} FROM pairs GROUP BY model) USING (model)
       JOIN (SELECT model, {', '.join(sr(f'avg({m})', f'macro_{m}') for m in _METRICS)},
               {', '.join(sr(f'sum({m} * support) / sum(support)', f'weighted_{m}') for m in _METRICS)} FROM scores GROUP BY model) USING (model)"""


@eval_query("e10_evaluate_all_models", EVALUATED)
def e10(spark, sf):
    return rounded(ev.evaluate(labels(spark, sf), predictions(spark, sf), test_users=None))


@query(
    "e10_evaluate_test_users",
    with_tables(
        EVALUATED, "true_labels", "preds",
        extra=EVAL | {"joined": EVAL["joined"] + " WHERE user_id IN ('Student_10', 'Student_8', 'Student_13', 'Student_11')"},
    ),
)
def e10_test(spark, sf):
    return rounded(ev.evaluate(labels(spark, sf), predictions(spark, sf)))


@eval_query(
    "e11_d9_rank_models",
    f"SELECT CAST(row_number() OVER (ORDER BY accuracy DESC, model) AS INTEGER) AS rank, model, accuracy FROM ({EVALUATED})",
)
def e11(spark, sf):
    return rounded(ev.rank_models(ev.evaluate(labels(spark, sf), predictions(spark, sf), test_users=None)))


@eval_query("d9_best_model", f"SELECT model, accuracy FROM ({EVALUATED}) ORDER BY accuracy DESC, model DESC LIMIT 1")
def d9(spark, sf):
    return rounded(ev.best_model(ev.evaluate(labels(spark, sf), predictions(spark, sf), test_users=None)))


@eval_query("e12_row_level_evaluation", "SELECT user_id, exercise_id, model, y_true, y_pred FROM joined WHERE y_true <> '' AND y_pred <> ''")
def e12(spark, sf):
    return ev.mapped(judged(spark, sf)).select(*KEYS, "model", "y_true", "y_pred")
