"""Queries over objectives, training loops, clustering, factorization, topics and scheduling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import StageConfig, parse_stages, store_update
from ..functions.ranks import LATTICE, lattice, with_position
from ..operators import clustering as km
from ..operators import factorization as mf
from ..operators import objectives as ob
from ..operators import schedule as sc
from ..operators import topics as ld
from ..sources.folders import kept, shared_folder
from ..streaming.training import checkpoint_folder, stream_orders, train_on_stream
from . import training as tr
from .views import POINTS, RATINGS, SAMPLES_LINEITEM, SAMPLES_ORDERS, TOKENS, TOPICS, points, ratings, samples_lineitem, samples_orders, table, token_blocks, word_batches

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


D = 3
W0 = [0.1, -0.2, 0.3, 0.05]
_NAMES = [f"w{k}" for k in range(D)] + ["b"]
_SIGNED = SAMPLES_LINEITEM.replace("THEN 1 ELSE 0 END", "THEN 1 ELSE -1 END")


def _weights(spark, weights: list[float], digits: int = 6) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(float, weights))), "key int, weight double").select("key", (F.round("weight", digits) + 0.0).alias("weight"))


def _model(weights) -> str:
    return "SELECT " + ", ".join(f"CAST({w!r} AS DOUBLE) AS {n}" for n, w in zip(_NAMES, weights))


def _unpivot(last: str, names=_NAMES, digits: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS key, round({n}, {digits}) + 0.0 AS weight FROM {last}" for k, n in enumerate(names))


def _steps_sql(samples: str, terms: list[str], weights: list[float], rates: list[float], batches: list[int] | None = None, prefix: str = "m", tail: str | None = None) -> str:
    """Training steps as chained CTEs."""
    parts = [f"{prefix}0 AS ({_model(weights)})"]
    keys = ", ".join(_NAMES)
    for t, rate in enumerate(rates):
        where = f" WHERE batch = {batches[t]}" if batches else ""
        gradient = ", ".join(f"{term} AS g{k}" for k, term in enumerate(terms))
        update = ", ".join(f"{n} - CAST({rate!r} AS DOUBLE) * g{k} AS {n}" for k, n in enumerate(_NAMES))
        parts.append(f"{prefix}{t + 1} AS MATERIALIZED (SELECT {update} FROM (SELECT {keys}, {gradient} FROM s, {prefix}{t}{where} GROUP BY {keys}))")
    return f"WITH s AS ({samples}), " + ", ".join(parts) + " " + (tail or _unpivot(f"{prefix}{len(rates)}"))


def _one(samples: str, term: str) -> str:
    return f"WITH s AS ({samples}), m AS ({_model(W0)}) SELECT round({term}, 6) AS value FROM s, m GROUP BY {', '.join(_NAMES)}"


def _signed(spark, d):
    return samples_lineitem(spark, d).withColumn("y", 2 * F.col("y") - 1)


def _value(df: DataFrame, term: str) -> DataFrame:
    return df.agg(F.round(F.expr(ob.bind(term, W0)), 6).alias("value"))


def _gradient(spark, df: DataFrame, terms: list[str]) -> DataFrame:
    return _weights(spark, tr.descend(df, terms, W0, 1, lambda t: 1.0))


# objectives: a gradient is shown as the weights after one step of size 1 ------------

_LR, _LASSO, _SVM = ob.lr_gradient(D), ob.lasso_gradient(D, 0.01), ob.svm_gradient(D, 0.01)


@query(_steps_sql(SAMPLES_LINEITEM, _LR, W0, [1.0]))
def ob_sigmoid_grad(spark, d):
    """OB-1."""
    return _gradient(spark, samples_lineitem(spark, d), _LR)


@query(_one(SAMPLES_LINEITEM, ob.lr_loss(D)))
def ob_log_loss(spark, d):
    """OB-2."""
    return _value(samples_lineitem(spark, d), ob.lr_loss(D))


@query(_one(SAMPLES_LINEITEM, ob.lr_loss(D, 1e-6)))
def ob_log_loss_clamped(spark, d):
    """OB-12."""
    return _value(samples_lineitem(spark, d), ob.lr_loss(D, 1e-6))


@query(_steps_sql(SAMPLES_LINEITEM, _LASSO, W0, [1.0]))
def ob_lasso_grad(spark, d):
    """OB-3."""
    return _gradient(spark, samples_lineitem(spark, d), _LASSO)


@query(_one(SAMPLES_LINEITEM, ob.lasso_loss(D, 0.01)))
def ob_lasso_loss(spark, d):
    """OB-4."""
    return _value(samples_lineitem(spark, d), ob.lasso_loss(D, 0.01))


@query(_steps_sql(_SIGNED, _SVM, W0, [1.0]))
def ob_svm_grad(spark, d):
    """OB-5."""
    return _gradient(spark, _signed(spark, d), _SVM)


@query(_one(_SIGNED, ob.svm_loss(D, 0.01)))
def ob_svm_loss(spark, d):
    """OB-6."""
    return _value(_signed(spark, d), ob.svm_loss(D, 0.01))


@query(_one(SAMPLES_LINEITEM, ob.accuracy(D)))
def ob_accuracy_lr(spark, d):
    """OB-8, 10, with intercept, over all rows."""
    return _value(samples_lineitem(spark, d), ob.accuracy(D))


@query(_one(SAMPLES_LINEITEM, ob.accuracy(D, intercept=False)))
def ob_accuracy_stream(spark, d):
    """OB-13, TR-23: sign of the score without intercept."""
    return _value(samples_lineitem(spark, d), ob.accuracy(D, intercept=False))


@query(_one(_SIGNED, ob.accuracy(D, intercept=False)))
def ob_accuracy_svm(spark, d):
    """OB-9."""
    return _value(_signed(spark, d), ob.accuracy(D, intercept=False))


@query("SELECT round(avg(pow(p_size - p_retailprice / 100, 2)), 6) AS value FROM part")
def ob_sq_dev(spark, d):
    """OB-11: squared deviation of two models joined by key."""
    part = table(spark, d, "part")
    a, b = part.select("p_partkey", F.col("p_size").alias("v")), part.select("p_partkey", (F.col("p_retailprice") / 100).alias("w"))
    return a.join(b, "p_partkey").agg(F.round(F.avg(F.pow(F.col("v") - F.col("w"), 2)), 6).alias("value"))


_ALPHAS = [round(0.1 * i, 1) for i in range(1, 11)]
_CORRECT = " + ".join(f"CAST(((({ob.score(D)})) - {a!r} * (g0 * x0 + g1 * x1 + g2 * x2 + g3) > 0) = (y > 0) AS INTEGER)" for a in _ALPHAS)


@query(f"""WITH s AS ({SAMPLES_LINEITEM}), m AS ({_model(W0)}), g AS (SELECT {', '.join(_NAMES)}, {', '.join(f'{t} AS g{k}' for k, t in enumerate(_LR))} FROM s, m GROUP BY {', '.join(_NAMES)})
  SELECT n_correct, count(*) AS n, n_correct > 5 AS correct FROM (SELECT {_CORRECT} AS n_correct FROM s, g) GROUP BY 1""")
def ob_ensemble_vote(spark, d):
    """OB-14: ten models, one step each with another step size, vote; one pass scores all."""
    s = samples_lineitem(spark, d)
    models = [tr.descend(s, _LR, W0, 1, lambda t, a=a: a) for a in _ALPHAS]
    votes = sum(((F.expr(ob.bind(ob.score(D), w)) > 0) == (F.col("y") > 0)).cast("int") for w in models)
    return s.select(votes.alias("n_correct")).groupBy("n_correct").agg(F.count("*").alias("n")).withColumn("correct", F.col("n_correct") > len(models) // 2)


# training loops -------------------------------------------------------------------

_ZERO = [0.0] * 4


def _by_batch(rows: DataFrame) -> DataFrame:
    """The samples laid out in one folder a batch, so that a step reads its own batch alone."""
    folder = shared_folder(rows.sparkSession, "batches")
    rows.write.partitionBy("batch").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


@query(_steps_sql(SAMPLES_LINEITEM, _LR, _ZERO, [0.5] * 5))
def tr_gd_lr(spark, d):
    """TR-10, 11, WK-1, 3, 6, SNK-1: full-gradient logistic regression."""
    return _weights(spark, tr.descend(samples_lineitem(spark, d), _LR, _ZERO, 5, lambda t: 0.5))


@query(_steps_sql(SAMPLES_LINEITEM, ob.lr_gradient(D, False), _ZERO, [0.5] * 5, [0, 1, 2, 3, 4]))
def tr_minibatch_frozen(spark, d):
    """TR-3: weights frozen in a batch, no intercept; five batches are the table."""
    return _weights(spark, tr.descend_batches(_by_batch(samples_lineitem(spark, d)), ob.lr_gradient(D, False), _ZERO, list(range(5)), lambda t: 0.5))


_DENSE = [f"-(avg(case when y * (w0 * x0 + w1 * x1 + w2 * x2) < 1 then 2 * y * x{k} else cast(0 as double) end) - w{k} * avg(case when x{k} <> 0 then cast(1 as double) else cast(0 as double) end))" for k in range(D)] + ["cast(0 as double)"]


@query(_steps_sql(_SIGNED, _DENSE, _ZERO, [0.3] * 5, [0, 1, 2, 3, 4]))
def tr_svm_dense(spark, d):
    """TR-5: mini-batch support vector steps that shrink the features present."""
    return _weights(spark, tr.descend_batches(_by_batch(_signed(spark, d)), _DENSE, _ZERO, list(range(5)), lambda t: 0.3))


@query(_steps_sql(SAMPLES_LINEITEM, _LASSO, W0, [0.2] * 4))
def tr_lasso(spark, d):
    """TR-6 with OB-3."""
    return _weights(spark, tr.descend(samples_lineitem(spark, d), _LASSO, W0, 4, lambda t: 0.2))


@query(_steps_sql(SAMPLES_LINEITEM, ob.lr_gradient(D, False), _ZERO, [0.5 - 0.1 * t for t in range(5)], [0, 1, 2, 3, 4]))
def tr_decay_linear(spark, d):
    """TR-7: the step size falls by a constant."""
    return _weights(spark, tr.descend_batches(_by_batch(samples_lineitem(spark, d)), ob.lr_gradient(D, False), _ZERO, list(range(5)), tr.linear_decay(0.5, 0.1)))


@query(_steps_sql(SAMPLES_LINEITEM, ob.lr_gradient(D, False), _ZERO, [0.5 * 0.8**t for t in range(5)], [0, 1, 2, 3, 4]))
def tr_decay_exp(spark, d):
    """TR-7: the step size falls by a factor."""
    return _weights(spark, tr.descend_batches(_by_batch(samples_lineitem(spark, d)), ob.lr_gradient(D, False), _ZERO, list(range(5)), tr.exponential_decay(0.5, 0.8)))


@query(_steps_sql(SAMPLES_LINEITEM, _LR, _ZERO, [max(1e-5, 0.6 / (t // 2 + 1)) for t in range(5)], [0, 1, 2, 3, 4]))
def tr_optimizer_decay(spark, d):
    """TR-6, 9: inverse decay of the generic optimizer."""
    return _weights(spark, tr.descend_batches(_by_batch(samples_lineitem(spark, d)), _LR, _ZERO, list(range(5)), tr.inverse_decay(0.6, 2)))


_STAGES = parse_stages("12000,12000", "3,2", "0.8,0.4", "2,4")
_STAGE_RATES = [s.alpha for s in _STAGES for _ in range(s.num_iters)]


@query(_steps_sql(SAMPLES_LINEITEM, _LR, _ZERO, _STAGE_RATES, [0, 1, 2, 3, 4]))
def tr_stages(spark, d):
    """TR-14, 15, KM-10: two stages, the iteration number going on from one to the next.

    W workers with a W-th of batch and step size each add up to the stage's step.
    """
    s, w, t = _by_batch(samples_lineitem(spark, d)), _ZERO, 0
    for stage in _STAGES:
        w = tr.descend_batches(s, _LR, w, list(range(t, t + stage.num_iters)), lambda _, a=stage.alpha: a)
        t += stage.num_iters
    return _weights(spark, w)


_GRID = [(a, c) for a in (0.2, 0.6) for c in (1, 2)]
_RUNS = [_steps_sql(SAMPLES_LINEITEM, _LR, _ZERO, [tr.inverse_decay(a, c)(t) for t in range(3)], tail=f"SELECT CAST({a} AS DOUBLE) AS alpha, CAST({c} AS INTEGER) AS decay, round({ob.lr_loss(D)}, 6) AS loss FROM s, m3 GROUP BY {', '.join(_NAMES)}") for a, c in _GRID]


@query(" UNION ALL ".join(f"SELECT * FROM ({r})" for r in _RUNS))
def tr_grid(spark, d):
    """TR-16: step size and decay by final loss."""
    s = samples_lineitem(spark, d)
    rows = []
    for a, c in _GRID:
        w = tr.descend(s, _LR, _ZERO, 3, tr.inverse_decay(a, c))
        rows.append((a, c, float(s.agg(F.expr(ob.bind(ob.lr_loss(D), w))).first()[0])))
    return spark.createDataFrame(rows, "alpha double, decay int, loss double").withColumn("loss", F.round("loss", 6))


_SIZES = (1, 2, 5)
_BATCHED = [_steps_sql(SAMPLES_LINEITEM.replace("% 5 AS batch", f"% {b} AS batch"), _LR, _ZERO, [0.4] * b, list(range(b)), tail=f"SELECT CAST({b} AS INTEGER) AS batches, round({ob.lr_loss(D)}, 6) AS loss FROM s, m{b} GROUP BY {', '.join(_NAMES)}") for b in _SIZES]


@query(" UNION ALL ".join(f"SELECT * FROM ({r})" for r in _BATCHED))
def tr_grid_batch(spark, d):
    """TR-16: one epoch in one, two or five batches by final loss."""
    rows = []
    for b in _SIZES:
        s = _by_batch(samples_lineitem(spark, d, b))
        w = tr.descend_batches(s, _LR, _ZERO, list(range(b)), lambda t: 0.4)
        rows.append((b, float(s.agg(F.expr(ob.bind(ob.lr_loss(D), w))).first()[0])))
    return spark.createDataFrame(rows, "batches int, loss double").withColumn("loss", F.round("loss", 6))


_WORKERS = (1, 2, 4)
_SHARED = [_steps_sql(SAMPLES_LINEITEM, _LR, _ZERO, [0.8 / w] * 3, tail=f"SELECT CAST({w} AS INTEGER) AS workers, CAST({(12000 - 1) // w + 1} AS INTEGER) AS batch_rows, CAST({0.8 / w} AS DOUBLE) AS alpha, round({ob.lr_loss(D)}, 6) AS loss FROM s, m3 GROUP BY {', '.join(_NAMES)}") for w in _WORKERS]


@query(" UNION ALL ".join(f"SELECT * FROM ({r})" for r in _SHARED))
def tr_grid_workers(spark, d):
    """TR-17, 15: a worker's rows of a batch (rounded up) and step size by number of workers, and the loss with that step."""
    s, rows = samples_lineitem(spark, d), []
    for n in _WORKERS:
        batch, alpha = StageConfig(12000, 3, 0.8, n).padded_share()
        w = tr.descend(s, _LR, _ZERO, 3, lambda t, a=alpha: a)
        rows.append((n, batch, alpha, float(s.agg(F.expr(ob.bind(ob.lr_loss(D), w))).first()[0])))
    return spark.createDataFrame(rows, "workers int, batch_rows int, alpha double, loss double").withColumn("loss", F.round("loss", 6))


def _fold_sql(update: dict[str, str], extra: str = "") -> str:
    names = list(update)
    return f"""WITH RECURSIVE s AS ({SAMPLES_ORDERS}), o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY pos) AS i FROM s){extra},
  r AS (SELECT part, CAST(0 AS BIGINT) AS i, {', '.join(f'CAST(0 AS DOUBLE) AS {n}' for n in names)} FROM (SELECT DISTINCT part FROM s)
    UNION ALL SELECT r.part, o.i, {', '.join(update.values())} FROM r JOIN o ON o.part = r.part AND o.i = r.i + 1{' , u' if extra else ''}),
  e AS (SELECT part, {', '.join(f'max_by({n}, i) AS {n}' for n in names)}, max(i) AS n FROM r GROUP BY part)"""


_P1 = "1 / (1 + exp(-(w0 * x0 + w1 * x1)))"
_P2 = "1 / (1 + exp(-(w0 * x0 + w1 * x1 + b)))"


@query(_fold_sql({f"w{k}": f"w{k} + 0.05 * x{k} * (y - {_P1})" for k in range(2)}) + " SELECT part, n, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM e")
def tr_sgd_single(spark, d):
    """TR-1, 2, WK-13: one sample a step, in order, by each of 64 workers."""

    def step(w, x, y):
        return w + 0.05 * x * (y - 1 / (1 + np.exp(-(w @ x))))

    f = tr.local_fold(samples_orders(spark, d), 2, step, [0.0, 0.0])
    return f.select("part", "n", F.round(F.col("state")[0], 6).alias("w0"), F.round(F.col("state")[1], 6).alias("w1"))


def _sequential(alpha: float):
    def step(w, x, y):
        e = alpha * (y - 1 / (1 + np.exp(-(w[:2] @ x + w[2]))))
        return w + e * np.array([x[0], x[1], 1.0])

    return step


_SEQ = _fold_sql({"w0": f"w0 + 0.02 * x0 * (y - {_P2})", "w1": f"w1 + 0.02 * x1 * (y - {_P2})", "b": f"b + 0.02 * (y - {_P2})"})


@query(_SEQ + " SELECT part, n, round(w0, 6) AS w0, round(w1, 6) AS w1, round(b, 6) AS b FROM e")
def tr_minibatch_seq(spark, d):
    """TR-4: batches in which every sample sees the updates before it (step size / batch = 0.02)."""
    f = tr.local_fold(samples_orders(spark, d), 2, _sequential(0.02), [0.0] * 3)
    return f.select("part", "n", *[F.round(F.col("state")[k], 6).alias(n) for k, n in enumerate(("w0", "w1", "b"))])


@query(_SEQ + " SELECT CAST(k AS INTEGER) AS key, round(CASE k WHEN 0 THEN avg(w0) WHEN 1 THEN avg(w1) ELSE avg(b) END, 6) AS weight FROM e, range(3) t(k) GROUP BY k")
def tr_local_sgd_average(spark, d):
    """WK-4, 5: lock-free workers, their models averaged."""
    f = tr.local_fold(samples_orders(spark, d), 2, _sequential(0.02), [0.0] * 3)
    return f.select(F.posexplode("state").alias("key", "v")).groupBy("key").agg(F.round(F.avg("v"), 6).alias("weight"))


_OLD = [0.3, -0.4]
_POLD = f"1 / (1 + exp(-({_OLD[0]} * x0 + {_OLD[1]} * x1)))"


@query(f"WITH s AS ({SAMPLES_ORDERS}) SELECT round(avg(x0 * ({_POLD} - y)), 6) AS u0, round(avg(x1 * ({_POLD} - y)), 6) AS u1 FROM s")
def tr_svrg_full_grad(spark, d):
    """TR-22: the full gradient at the old weights."""
    return samples_orders(spark, d).agg(*[F.round(F.expr(f"avg(x{k} * ({_POLD} - y))"), 6).alias(f"u{k}") for k in range(2)])


_SVRG = f", u AS (SELECT avg(x0 * ({_POLD} - y)) AS u0, avg(x1 * ({_POLD} - y)) AS u1 FROM s)"
_DIFF = f"({_P1} - {_POLD})"


@query(_fold_sql({f"w{k}": f"w{k} - 0.05 * (x{k} * {_DIFF} + u{k})" for k in range(2)}, _SVRG) + " SELECT CAST(k AS INTEGER) AS key, round(CASE k WHEN 0 THEN avg(w0) ELSE avg(w1) END, 6) AS weight FROM e, range(2) t(k) GROUP BY k")
def tr_svrg_epoch(spark, d):
    """TR-22: an inner epoch of variance-reduced steps; the workers' models are averaged."""
    s, old = samples_orders(spark, d), np.array(_OLD)
    u = np.array(s.agg(*[F.expr(f"avg(x{k} * ({_POLD} - y))") for k in range(2)]).first())

    def step(w, x, y):
        return w - 0.05 * (x * (1 / (1 + np.exp(-(w @ x))) - 1 / (1 + np.exp(-(old @ x)))) + u)

    f = tr.local_fold(s, 2, step, [0.0, 0.0])
    return f.select(F.posexplode("state").alias("key", "v")).groupBy("key").agg(F.round(F.avg("v"), 6).alias("weight"))


@query()
def tr_stream_sgd(spark, d):
    """TR-12, 13, 18, SRC-4, 8: training while reading a stream."""
    w, n = train_on_stream(stream_orders(spark, d), 2, 0.5, checkpoint_folder(spark))
    return _weights(spark, w).withColumn("n", F.lit(n))


# k-means -----------------------------------------------------------------------------

K = 5
_D2 = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: pow(p.x[i] - c.x[i], 2)))"
_C0 = f"pts AS ({POINTS}), c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, x FROM pts ORDER BY vec_id LIMIT {K})"


def _assign_sql(n: int) -> str:
    return f"a{n} AS (SELECT vec_id, any_value(x) AS x, min(s.k) FILTER (WHERE s.d = m) AS k, any_value(m) AS d FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS m FROM (SELECT p.vec_id, p.x, c.k, round({_D2}, 9) AS d FROM pts p, c{n} c)) s GROUP BY vec_id)"


def _center_sql(n: int) -> str:
    return f"e{n} AS (SELECT k, i, avg(v) AS v FROM (SELECT k, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY k, i), c{n + 1} AS (SELECT k, list(v ORDER BY i) AS x FROM e{n} GROUP BY k)"


@query(f"WITH {_C0}, {_assign_sql(0)} SELECT vec_id, CAST(k AS INTEGER) AS k, round(d, 6) AS d FROM a0")
def km_assign(spark, d):
    """KM-1, 2, 4: nearest of the first five points."""
    p = points(spark, d)
    best = km.nearest(F.col("x"), km.first_centers(p, K))
    return p.select("vec_id", best.getField("k").alias("k"), F.round(best.getField("d"), 6).alias("d"))


@query(f"WITH {_C0}, {_assign_sql(0)} SELECT CAST(k AS INTEGER) AS k, count(*) AS n, round(sum(d), 4) AS wssse FROM a0 GROUP BY k")
def km_wssse(spark, d):
    """KM-3: sum of squared distances and sizes of clusters."""
    p = points(spark, d)
    best = km.nearest(F.col("x"), km.first_centers(p, K))
    return p.select(best.getField("k").alias("k"), best.getField("d").alias("d")).groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("d"), 4).alias("wssse"))


@query(f"WITH {_C0}, {', '.join(_assign_sql(n) + ', ' + _center_sql(n) for n in range(3))} SELECT CAST(k AS INTEGER) AS k, i, round(v, 5) + 0.0 AS v FROM (SELECT k, unnest(x) AS v, unnest(range(len(x))) AS i FROM c3)")
def km_lloyd3(spark, d):
    """KM-9: three full steps."""
    centers = km.lloyd(points(spark, d), km.first_centers(points(spark, d), K), 3)
    return spark.createDataFrame([(k, i, float(v)) for k, c in enumerate(centers) for i, v in enumerate(c)], "k int, i bigint, v double").select("k", "i", (F.round("v", 5) + 0.0).alias("v"))


def _pp_sql(rounds: int, shares: list[float] | None = None) -> str:
    parts = [f"pts AS ({POINTS})", "q0 AS (SELECT vec_id, x, CAST(0 AS DOUBLE) AS d FROM pts ORDER BY vec_id LIMIT 1)"]
    for t in range(1, rounds):
        chosen = " UNION ALL ".join(f"SELECT x FROM q{i}" for i in range(t))
        parts.append(f"d{t} AS (SELECT p.vec_id, any_value(p.x) AS x, min(round({_D2}, 9)) AS d FROM pts p, ({chosen}) c GROUP BY p.vec_id)")
        parts.append(f"q{t} AS (SELECT vec_id, x, d FROM (SELECT *, sum(d) OVER (ORDER BY vec_id) AS upto, sum(d) OVER () AS total FROM d{t}) WHERE upto >= CAST({(shares[t] if shares else 0.5)!r} AS DOUBLE) * total ORDER BY vec_id LIMIT 1)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT CAST({t} AS INTEGER) AS round, vec_id, round(d, 6) AS d FROM q{t}" for t in range(rounds))


@query(_pp_sql(4))
def km_plus_plus_d2(spark, d):
    """KM-5, 7: centers by cumulated squared distance."""
    return km.plus_plus(points(spark, d), 4).withColumn("d", F.round("d", 6))


#: Uniform draws of the rounds, seeded.
_SHARES = np.random.default_rng(17).random(5).tolist()


@query(_pp_sql(5, _SHARES))
def km_plus_plus_drawn(spark, d):
    """KM-5, 7: centers drawn in proportion to squared distance."""
    return km.plus_plus(points(spark, d), 5, _SHARES).withColumn("d", F.round("d", 6))


_DRAWN = LATTICE.format(key="vec_id", seed=3, size=9973)


@query(f"""WITH pts AS ({POINTS}), one AS (SELECT min(vec_id) AS vec_id FROM pts GROUP BY x) SELECT CAST(row_number() OVER (ORDER BY {_DRAWN}, vec_id) - 1 AS INTEGER) AS k, vec_id FROM one ORDER BY k LIMIT {K}""")
def km_random_init(spark, d):
    """KM-4, 7: five distinct points in a seeded order."""
    return spark.createDataFrame(list(enumerate(km.random_ids(points(spark, d), K, lattice(3, "vec_id")))), "k int, vec_id bigint")


@query()
def km_minibatch_seq(spark, d):
    """KM-8, 9: sequential steps of 16 workers, deltas of centers summed."""
    p = points(spark, d)
    centers = km.mini_batch(p.withColumn("part", F.col("vec_id") % 16), km.first_centers(p, K))
    return spark.createDataFrame([(k, i, float(v)) for k, c in enumerate(centers) for i, v in enumerate(c)], "k int, i bigint, v double")


@query()
def km_parallel_init(spark, d):
    """KM-6: oversampled rounds, then weighted choice."""
    centers = km.parallel_init(points(spark, d), K)
    return spark.createDataFrame([(k, i, float(v)) for k, c in enumerate(centers) for i, v in enumerate(c)], "k int, i bigint, v double")


# matrix factorization ---------------------------------------------------------------

_F = lambda key: f"""SELECT DISTINCT "{key}", (("{key}" * 37) % 100) / 100 AS f0, (("{key}" * 37 + 17) % 100) / 100 AS f1 FROM r"""


def _half_sql(by: str, other: str, factors: str) -> str:
    return f"""(SELECT "{by}", (c * p - b * q) / (a * c - b * b) AS f0, (a * q - b * p) / (a * c - b * b) AS f1 FROM (SELECT "{by}", sum(f0 * f0) + 0.01 * count(*) AS a,
  sum(f0 * f1) AS b, sum(f1 * f1) + 0.01 * count(*) AS c, sum(rating * f0) AS p, sum(rating * f1) AS q FROM r JOIN {factors} USING ("{other}") GROUP BY "{by}"))"""


_ALS = f"WITH r AS ({RATINGS}), i0 AS ({_F('item')}), u1 AS {_half_sql('user', 'item', 'i0')}, i1 AS {_half_sql('item', 'user', 'u1')}"


def _als(spark, d):
    r = kept(ratings(spark, d), "ratings")
    items = mf.start_factors(r.select("item").distinct(), "item", 2)
    users = mf.als_half_step(r, "user", "item", items, 0.01)
    return r, users, items


@query(_ALS + ' SELECT "user", round(f0, 4) AS f0, round(f1, 4) AS f1 FROM u1')
def mf_als_half_user(spark, d):
    """MF-1, 2, 4: user factors from the first item factors."""
    return _als(spark, d)[1].select("user", F.round("f0", 4).alias("f0"), F.round("f1", 4).alias("f1"))


@query(_ALS + " SELECT item, round(f0, 4) AS f0, round(f1, 4) AS f1 FROM i1")
def mf_als_2iter(spark, d):
    """MF-2: users, then items."""
    r, users, _ = _als(spark, d)
    return mf.als_half_step(r, "item", "user", users, 0.01).select("item", F.round("f0", 4).alias("f0"), F.round("f1", 4).alias("f1"))


_PRED = "greatest(1, least(5, u.f0 * i.f0 + u.f1 * i.f1))"


@query(_ALS + f""" SELECT count(*) AS n, round(avg(pow(rating - {_PRED}, 2)), 6) AS mse, round(sqrt(avg(pow(rating - {_PRED}, 2))), 6) AS rmse FROM r JOIN u1 u USING ("user") JOIN i0 i USING (item)""")
def mf_rmse(spark, d):
    """MF-3, 6: clamped predictions; mean squared error and its root."""
    r, users, items = _als(spark, d)
    return mf.squared_error(r, users, items)


@query()
def mf_als_rank4(spark, d):
    """MF-1, 2, 3, 4: three iterations of rank 4 and the error; any rank is solved row by row in batches."""
    r = ratings(spark, d)
    items = mf.start_factors(r.select("item").distinct(), "item", 4)
    rows = []
    for i in range(3):
        users = mf.als_half_step_any(r, "user", "item", items, 0.01, 4)
        items = mf.als_half_step_any(r, "item", "user", users, 0.01, 4)
        # factors are written between iterations, so that plans don't grow
        users, items = kept(users, "users"), kept(items, "items")
        rows.append((i, mf.squared_error(r, users, items, 4).first().mse))
    return spark.createDataFrame(rows, "iteration int, mse double")


@query()
def mf_sgd_block(spark, d):
    """MF-5, 6: an epoch of stratified steps and its error."""
    r = kept(ratings(spark, d), "ratings")
    users, items = mf.sgd_epoch(r, mf.start_factors(r.select("user").distinct(), "user", 2), mf.start_factors(r.select("item").distinct(), "item", 2), 4, 0.05)
    return mf.squared_error(r, users, items)


@query(f"""WITH r AS ({RATINGS}) SELECT CAST((item % 4 - "user" % 4 + 4) % 4 AS BIGINT) AS step, "user" % 4 AS worker, item % 4 AS block, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def mf_strata(spark, d):
    """MF-5: which worker has which item block in which sub-step."""
    r = ratings(spark, d)
    return r.groupBy(((F.col("item") % 4 - F.col("user") % 4 + 4) % 4).alias("step"), (F.col("user") % 4).alias("worker"), (F.col("item") % 4).alias("block")).agg(F.count("*").alias("n"))


# topics -------------------------------------------------------------------------------

A, B = 0.1, 0.1


@query(f"WITH {TOKENS} SELECT word_id, topic, count(*) AS n FROM tokens GROUP BY 1, 2 UNION ALL SELECT -1, topic, count(*) FROM tokens GROUP BY topic")
def ld_counts(spark, d):
    """LD-1, 11: word and topic counts."""
    return ld.counts(token_blocks(spark, d))


@query(f"""WITH {TOKENS}, w AS (SELECT DISTINCT doc_id % 10 AS batch, word_id FROM tokens), p AS (SELECT *, (row_number() OVER (PARTITION BY batch ORDER BY word_id) - 1) // 20 AS slice FROM w)
  SELECT batch, slice, count(*) AS n, min(word_id) AS first, max(word_id) AS last FROM p GROUP BY 1, 2""")
def ld_vocab_slices(spark, d):
    """LD-2: a batch's vocabulary in slices of 20 words."""
    rows = with_position(word_batches(spark, d, 10), "word_id", "i", ("class",))
    batch = F.when(F.col("class") < 19, F.col("class") - 9).cast("bigint").alias("batch")
    slices = rows.groupBy("class", F.floor(F.col("i") / 20).alias("slice")).agg(F.count("*").alias("n"), F.min("word_id").alias("first"), F.max("word_id").alias("last"))
    return slices.select(batch, "slice", "n", "first", "last")


@query(f"""WITH {TOKENS}, pairs AS (SELECT DISTINCT doc_id, word_id FROM tokens), k AS (SELECT range AS topic FROM range({TOPICS})),
  dk AS (SELECT doc_id, topic, count(*) AS dk FROM tokens GROUP BY 1, 2), wk AS (SELECT word_id, topic, count(*) AS wk FROM tokens GROUP BY 1, 2), v AS (SELECT count(DISTINCT word_id) AS v FROM tokens), nk AS (SELECT topic, count(*) AS nk FROM tokens GROUP BY 1),
  w AS (SELECT doc_id, word_id, topic, CAST((coalesce(dk, 0) + {A}) AS DOUBLE) * (coalesce(wk, 0) + {B}) / (coalesce(nk, 0) + v * {B}) AS weight FROM pairs CROSS JOIN k LEFT JOIN dk USING (doc_id, topic) LEFT JOIN wk USING (word_id, topic) LEFT JOIN nk USING (topic), v)
  SELECT doc_id, word_id, {', '.join(f'round(max(weight) FILTER (WHERE topic = {k}) / sum(weight), 6) AS p{k}' for k in range(TOPICS))} FROM w GROUP BY doc_id, word_id""")
def ld_posterior(spark, d):
    """LD-4: topic posterior of every word of every document."""
    return ld.posterior(token_blocks(spark, d), TOPICS, A, B)


@query(f"""WITH {TOKENS}, n AS (SELECT doc_id, topic, count(*) AS n FROM tokens GROUP BY 1, 2), p AS (SELECT doc_id, sum(n) AS total, count(*) AS used, sum(lgamma(n + {A})) AS s FROM n GROUP BY 1)
  SELECT round(sum(lgamma({TOPICS} * {A}) - {TOPICS} * lgamma({A}) + s + ({TOPICS} - used) * lgamma({A}) - lgamma(total + {TOPICS} * {A})), 3) AS llh FROM p""")
def ld_doc_llh(spark, d):
    """LD-5, 8, 9."""
    return ld.doc_likelihood(ld.doc_counts(token_blocks(spark, d)), TOPICS, A).select(F.round("llh", 3).alias("llh"))


@query(f"""WITH {TOKENS}, n AS (SELECT word_id, topic, count(*) AS n FROM tokens GROUP BY 1, 2), p AS (SELECT word_id, sum(lgamma(n + {B})) AS s, count(*) AS used FROM n GROUP BY 1)
  SELECT round(sum(s + ({TOPICS} - used) * lgamma({B})), 3) AS llh FROM p""")
def ld_word_llh(spark, d):
    """LD-6."""
    return ld.word_likelihood(ld.word_counts(token_blocks(spark, d)), TOPICS, B).select(F.round("llh", 3).alias("llh"))


@query(f"""WITH {TOKENS}, v AS (SELECT count(DISTINCT word_id) AS v FROM tokens), n AS (SELECT topic, count(*) AS n FROM tokens GROUP BY 1)
  SELECT round({TOPICS} * (lgamma(v * {B}) - v * lgamma({B})) - sum(lgamma(n + v * {B})) - ({TOPICS} - count(*)) * lgamma(v * {B}), 3) AS llh FROM n, v GROUP BY v""")
def ld_summary_llh(spark, d):
    """LD-7."""
    words = kept(ld.word_counts(token_blocks(spark, d)), "word-counts")
    return ld.summary_likelihood(words, TOPICS, ld.vocabulary_size(words), B).select(F.round("llh", 3).alias("llh"))


@query()
def ld_gibbs(spark, d):
    """LD-3, 10: counts after a Gibbs sweep."""
    return ld.counts(ld.gibbs_sweep(token_blocks(spark, d), TOPICS, A, B, seed=5))


@query()
def ld_train(spark, d):
    """LD-3, 10, SNK-2: three sweeps, each of which appends its statistics; (iteration, llh)."""
    stats = shared_folder(spark, "lda-stats")
    ld.train(token_blocks(spark, d), TOPICS, A, B, 3, stats)
    return spark.read.parquet(stats).select("iteration", F.round("llh", 3).alias("llh"))


# scheduling and π ------------------------------------------------------------------------

_TIMES = "SELECT CAST(user_id % 6 AS INTEGER) + 1 AS workers, round(avg(value), 6) AS time FROM events GROUP BY 1"


@query(f"""WITH t AS ({_TIMES}), b AS (SELECT coalesce((SELECT min(workers) - 1 FROM (SELECT workers, time > lag(time) OVER (ORDER BY workers) AS slower FROM t) WHERE slower), (SELECT max(workers) FROM t)) AS increase,
  (SELECT min_by(workers, (time, workers)) FROM t WHERE workers <= 5) AS best) SELECT CAST(increase AS INTEGER) AS increase_best, CAST(best AS INTEGER) AS best_of_first FROM b""")
def sc_auto_parallel_plan(spark, d):
    """SC-9: numbers of workers that two policies choose from measured times."""
    t = table(spark, d, "events").groupBy((F.col("user_id") % 6).alias("w")).agg(F.round(F.avg("value"), 6).alias("time")).orderBy("w")
    times = [r.time for r in t.collect()]
    return spark.createDataFrame([(sc.increase_best(times), sc.best_of_first(times))], "increase_best int, best_of_first int")


@query("""SELECT mode, CAST(process AS INTEGER) AS process, CAST(threads AS INTEGER) AS threads FROM (
  SELECT 'threads_per_worker' AS mode, range AS process, 3 AS threads FROM range(4) UNION ALL SELECT 'threads_per_cluster', range, 10 // 4 + CASE WHEN range < 10 % 4 THEN 1 ELSE 0 END FROM range(4)
  UNION ALL SELECT 'local_threads', range, 5 FROM range(4) UNION ALL SELECT 'threads_traverse_cluster', range, CASE WHEN range = 6 % 4 THEN 4 ELSE 0 END FROM range(4)
  UNION ALL SELECT 'threads_on_worker', range, CASE WHEN range = 1 THEN 2 ELSE 0 END FROM range(4))""")
def sc_placement(spark, d):
    """SC-2, 3: threads by process for each placement mode."""
    modes = {"threads_per_worker": dict(amount=3), "threads_per_cluster": dict(amount=10), "local_threads": dict(amount=0), "threads_traverse_cluster": dict(amount=4, epoch=6), "threads_on_worker": dict(amount=2, target=1)}
    rows = [(m, p, t) for m, options in modes.items() for p, t in enumerate(sc.placement(m, processes=4, threads=5, **options))]
    return spark.createDataFrame(rows, "mode string, process int, threads int")


@query("""WITH r AS (SELECT event_type AS task, count(*) FILTER (WHERE value > 99) AS n FROM events GROUP BY 1)
  SELECT task, n AS rejections, n >= 5 AS angry, CAST(row_number() OVER (ORDER BY n < 5, n DESC, task) AS INTEGER) AS turn FROM r""")
def sc_priority_queue(spark, d):
    """SC-4, 5, 6: rejected tasks move up, often rejected ones go first."""
    counts = {r.event_type: r.n for r in table(spark, d, "events").groupBy("event_type").agg(F.sum((F.col("value") > 99).cast("int")).alias("n")).collect()}
    rows = [(t, n, angry, i) for i, (t, n, angry) in enumerate(sc.priority_order(counts), 1)]
    return spark.createDataFrame(rows, "task string, rejections bigint, angry boolean, turn int")


@query("SELECT min_by(process, (n, process)) AS process, min(n) AS visits FROM (SELECT user_id % 7 AS process, count(*) AS n FROM events GROUP BY 1)")
def sc_least_visited(spark, d):
    """SC-7: the process visited least."""
    visits = table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("process")).agg(F.count("*").alias("n"))
    return visits.agg(F.min_by("process", F.struct("n", "process")).alias("process"), F.min("n").alias("visits"))


@query("""SELECT * FROM (VALUES ('', '', '', 'assign'), ('', '', 'add', 'add'), ('Single', '', '', 'assign'), ('Hogwild', '', '', 'assign'), ('SPMT', 'BSP', '', 'assign'),
  ('PS', 'ASP', '', 'add'), ('PS', 'BSP', '', 'bsp-add'), ('PS', 'BSP', 'assign', 'bsp-assign'), ('PS', 'SSP', '', 'ssp-add')) t(kind, consistency, "update", result)""")
def kv_update_type(spark, d):
    """KV-15, 16, WK-2: how a store applies pushes."""
    asked = [("", "", ""), ("", "", "add"), ("Single", "", ""), ("Hogwild", "", ""), ("SPMT", "BSP", ""), ("PS", "ASP", ""), ("PS", "BSP", ""), ("PS", "BSP", "assign"), ("PS", "SSP", "")]
    return spark.createDataFrame([(*a, store_update(*a)) for a in asked], "kind string, consistency string, update string, result string")


_THROW = "SELECT worker, {x} AS x, {y} AS y FROM (SELECT w.range AS worker, w.range * 1000 + p.range AS id FROM range(8) w, range(1000) p)".format(x=LATTICE.format(key="id", seed=1, size=9973), y=LATTICE.format(key="id", seed=77, size=9949))


@query(f"SELECT CAST(0 AS INTEGER) AS key, CAST(sum(CASE WHEN x * x + y * y <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS inside, count(*) AS n, round(4 * avg(CASE WHEN x * x + y * y <= 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS pi FROM ({_THROW})")
def mc_pi_sampled(spark, d):
    """MC-1: a thousand seeded points of each of eight workers, summed under one key."""
    throws = spark.range(0, 8000, 1, 8).select((F.floor(F.col("id") / 1000)).alias("worker"), lattice(1, "id").alias("x"), lattice(77, "id", 9949).alias("y"))
    hit = (F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1).cast("bigint")
    local = throws.groupBy("worker").agg(F.sum(hit).alias("inside"), F.count("*").alias("n"))
    return local.groupBy(F.lit(0).alias("key")).agg(F.sum("inside").alias("inside"), F.sum("n").alias("n")).withColumn("pi", F.round(4 * F.col("inside") / F.col("n"), 6))


@query("SELECT round(4 * avg(CASE WHEN pow((i % 1000 + 0.5) / 1000, 2) + pow((i // 1000 + 0.5) / 1000, 2) <= 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS pi FROM range(1000000) t(i)")
def mc_pi(spark, d):
    """MC-1: π from a lattice of a million points."""
    x, y = (F.col("id") % 1000 + 0.5) / 1000, (F.floor(F.col("id") / 1000) + 0.5) / 1000
    return spark.range(1_000_000).agg(F.round(4 * F.avg((x * x + y * y <= 1).cast("double")), 6).alias("pi"))
