"""Target statistics, text features and embedding features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.random import uniform
from .ranges import place, running


# --- target statistics -------------------------------------------------------------------------------------------


def ordered_ctr(df: DataFrame, category: str, target: str, order: str, prior: float = 0.5, buckets: int = 15) -> DataFrame:
    """Add ctr and ctr_bucket: the target mean of earlier rows of the category, read before the row itself is added."""
    past = W.partitionBy(category).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    good, total = F.coalesce(F.sum(target).over(past), F.lit(0)), F.count(F.lit(1)).over(past)
    return df.withColumn("ctr", ((good + prior) / (total + 1)).cast("float")).withColumn("ctr_bucket", F.floor(F.col("ctr") * F.lit(float(buckets)).cast("float")).cast("int"))


def target_classes(label: Column, borders: list[float]) -> Column:
    """The class of a label: the number of borders below it."""
    return sum(((label > b).cast("int") for b in borders), F.lit(0))


def ctr_bin(good: Column, total: Column, prior: float, buckets: int) -> Column:
    """The bucket of (good + prior) / (total + 1), shifted and scaled into [0, 1] for priors outside of it; in single precision."""
    shift, norm = max(0.0, -prior), max(1.0, prior) - min(0.0, prior)
    f = lambda c: c.cast("float")
    ctr = f(f(good) + F.lit(prior).cast("float")) / f(total + 1)
    scaled = f(f(f(ctr) + F.lit(shift).cast("float")) / F.lit(norm).cast("float")) * F.lit(float(buckets)).cast("float")
    return F.least(F.lit(buckets), F.greatest(F.lit(0), F.floor(f(scaled)))).cast("int")


def ordered_ctr_classes(df: DataFrame, category: str, cls: str, order: str, border: int, kind: str = "Borders", prior: float = 0.5, buckets: int = 15, out: str = "ctr_bucket") -> DataFrame:
    """Ordered statistics of a target with several classes: earlier rows of class `border` (Buckets) or of any class above it
    (Borders), over all earlier rows of the category."""
    past = W.partitionBy(category).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    hit = F.col(cls) == border if kind == "Buckets" else F.col(cls) > border
    good = F.coalesce(F.sum(hit.cast("int")).over(past), F.lit(0))
    return df.withColumn(out, ctr_bin(good, F.count(F.lit(1)).over(past), prior, buckets))


def ordered_ctr_mean(df: DataFrame, category: str, cls: str, order: str, classes: int, prior: float = 0.5, buckets: int = 15, out: str = "ctr_bucket") -> DataFrame:
    """The ordered mean of the class number over the highest class."""
    past = W.partitionBy(category).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    good = F.coalesce(F.sum(F.col(cls) / (classes - 1)).over(past), F.lit(0.0))
    return df.withColumn(out, ctr_bin(good, F.count(F.lit(1)).over(past), prior, buckets))


def permutation(row: Column, block: int, seed: int, number: int) -> Column:
    """The order of a permutation of blocks of consecutive rows: blocks by a keyed draw, rows inside as they are."""
    return F.struct(uniform(F.floor(row / block), seed * 1_000_003 + number).alias("draw"), row.alias("row"))


def ctr_columns(df: DataFrame, category: str, cls: str, order: str, classes: int, priors: tuple[float, ...] = (0.0, 0.5, 1.0), buckets: int = 15) -> DataFrame:
    """All ordered statistics of a category: of every border and every prior, the mean, and the counter."""
    out = df
    for p in priors:
        for b in range(classes - 1):
            out = ordered_ctr_classes(out, category, cls, order, b, "Borders", p, buckets, f"{category}_borders{b}_{p:g}")
        out = ordered_ctr_mean(out, category, cls, order, classes, p, buckets, f"{category}_mean_{p:g}")
    return out


def counter_ctr(df: DataFrame, category: str) -> DataFrame:
    """(category, n, ctr): count over the largest count."""
    c = df.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    top = c.agg(F.max("n").alias("top"))
    return c.crossJoin(F.broadcast(top)).select("category", "n", (F.col("n") / (F.col("top") + 1)).alias("ctr"))


def ctr_table(df: DataFrame, category: str, target: str, prior: float = 0.5) -> DataFrame:
    """(category, good, total, ctr) for prediction."""
    t = df.groupBy(F.col(category).alias("category")).agg(F.sum(target).alias("good"), F.count(F.lit(1)).alias("total"))
    return t.withColumn("ctr", (F.col("good") + prior) / (F.col("total") + 1))


def apply_ctr(df: DataFrame, table: DataFrame, category: str, prior: float = 0.5, out: str = "ctr") -> DataFrame:
    """The table's value for each row; unseen categories get the prior."""
    t = table.select(F.col("category").alias("__c"), F.col("ctr").alias(out))
    return df.join(t, df[category].eqNullSafe(F.col("__c")), "left").drop("__c").withColumn(out, F.coalesce(out, F.lit(float(prior))))


def combination(columns: list[str]) -> Column:
    """One category of several, for combination statistics."""
    return F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns])


# --- text ---------------------------------------------------------------------------------------------------------


def tokens(text: Column, lower: bool = False, delimiter: str = " ") -> Column:
    t = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if lower else text
    return F.filter(F.split(t, f"\\Q{delimiter}\\E"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n tokens joined by a zero byte; none for shorter texts."""
    if n == 1:
        return words
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), "\x00"))).otherwise(F.array().cast("array<string>"))


def dictionary(df: DataFrame, text: str, at_least: int = 3, most: int | None = 50_000, n: int = 1, lower: bool = False) -> DataFrame:
    """(token, n, token_id): tokens by falling count, then by token; the `most` first ones (the dictionary's size), or all
    for None."""
    t = df.select(F.explode(ngrams(tokens(F.col(text), lower), n)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    if most is None:
        order = [F.desc("n"), F.col("token")]
        return running(place(t, order), {"token_id": F.lit(1)}, [], order).select("token", "n", F.col("token_id").cast("int"))
    top = t.orderBy(F.desc("n"), "token").limit(most)
    return top.withColumn("token_id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token")) - 1)


def bag(df: DataFrame, key: str, text: str, words: DataFrame, n: int = 1, lower: bool = False) -> DataFrame:
    """(key, token_id, n): a sparse row per text; tokens outside the dictionary are dropped."""
    t = df.select(key, F.explode(ngrams(tokens(F.col(text), lower), n)).alias("token"))
    return t.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")).join(words.select("token", "token_id"), "token").select(key, "token_id", "n")


def naive_bayes(bags: DataFrame, labels: DataFrame, key: str, label: str, prior: float = 0.5) -> DataFrame:
    """(key, class, log_prob): multinomial naive Bayes log scores, unnormalised."""
    known = bags.join(labels.select(key, label), key)
    per = known.groupBy(label, "token_id").agg(F.sum("n").alias("n"))
    whole = per.groupBy(label).agg(F.sum("n").alias("total"))
    vocabulary = bags.agg(F.countDistinct("token_id").alias("v"))
    docs = labels.groupBy(label).agg(F.count(F.lit(1)).alias("docs"))
    shape = whole.join(docs, label).crossJoin(F.broadcast(vocabulary)).crossJoin(F.broadcast(labels.agg(F.count(F.lit(1)).alias("all"))))
    size = bags.groupBy(key).agg(F.sum("n").alias("size"))
    # every class of every text is a row of the result; tokens meet only the classes that have them
    rest = size.crossJoin(F.broadcast(shape)).select(key, label, (F.col("size") * F.log(prior / (F.col("total") + prior * F.col("v"))) + F.log(F.col("docs") / F.col("all"))).alias("rest"))
    met = bags.join(per.withColumnRenamed("n", "c"), "token_id").groupBy(key, label).agg(F.sum(F.col("n") * F.log((F.col("c") + prior) / prior)).alias("met"))
    return rest.join(met, [key, label], "left").select(key, label, (F.col("rest") + F.coalesce("met", F.lit(0.0))).alias("log_prob"))


def bm25(bags: DataFrame, labels: DataFrame, key: str, label: str, k: float = 1.5, b: float = 0.75, least: float = 1e-3) -> DataFrame:
    """(key, class, score): each class is one document of the index; a text's distinct tokens are the query."""
    known = bags.join(labels.select(key, label), key)
    tf = known.groupBy(label, "token_id").agg(F.sum("n").alias("tf"))
    size = tf.groupBy(label).agg(F.sum("tf").alias("len"))
    mean = size.agg(F.avg("len").alias("mean"), F.count(F.lit(1)).alias("classes"))
    df = tf.groupBy("token_id").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(F.broadcast(size), label).crossJoin(F.broadcast(mean)).join(df, "token_id")
    idf = F.greatest(F.lit(least), F.log((F.col("classes") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    w = w.withColumn("w", idf * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("mean"))))
    return bags.join(w.select(label, "token_id", "w"), "token_id").groupBy(key, label).agg(F.sum("w").alias("score"))


# --- embeddings ---------------------------------------------------------------------------------------------------


def knn(df: DataFrame, key: str, vector: str, label: str, k: int = 5, queries: DataFrame | None = None, block: int = 32_000) -> DataFrame:
    """(key, label, n): classes of the k nearest other vectors by L2, ties by key.

    Queries and index are cut into blocks of about `block` rows by a hash of the key; every pair of blocks is one group, in
    which each query keeps its k nearest, and the nearest of all blocks are taken from these. Inside a group, products of
    matrices in single precision rule out what lies beyond the k-th distance by more than their error; the rest is measured
    in double precision. Any number of rows will do; the work grows with queries times rows.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n, m = df.count(), (queries if queries is not None else df).count()
    blocks, parts = max(1, -(-n // block)), max(1, -(-m // block))
    kind = dict(df.dtypes)[key]
    exact = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"

    def side(rows: DataFrame, own: int, other: int, mine: str, theirs: str, index: bool) -> DataFrame:
        here = F.pmod(F.xxhash64(key, F.lit(int(index))), F.lit(own)).cast("int")
        cls = F.col(label).cast("string") if index else F.lit(None).cast("string")
        cells = rows.select(F.col(key).alias("k"), F.col(vector).cast(exact).alias("x"), cls.alias("label"), F.lit(index).alias("index"), here.alias(mine))
        return cells.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).select("k", "x", "label", "index", "qb", "ib")

    both = side(queries if queries is not None else df, parts, blocks, "qb", "ib", False).unionByName(side(df, blocks, parts, "ib", "qb", True))

    def finite(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The rows whose vectors are finite, and these."""
        x = pa.concat_arrays(rows.column("x").chunks)
        size = pc.min_max(pc.list_value_length(x)).as_py()
        if x.null_count or size["min"] != size["max"]:
            raise ValueError("vectors are null or differ in length")
        v = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
        good = np.isfinite(v).all(1)
        return rows.filter(pa.array(good)), v[good]

    def nearest(group: pa.Table) -> pa.Table:
        index = group.column("index")
        q, i = group.filter(pc.invert(index)), group.filter(index).sort_by("k")
        if q.num_rows and i.num_rows:
            (q, x), (i, y) = finite(q), finite(i)
        found = []
        if q.num_rows and i.num_rows:
            names = i.column("k").unique()
            code = lambda t: pc.fill_null(pc.index_in(t.column("k"), value_set=names), -1).to_numpy()
            qc, ic = code(q), code(i)
            most = k + int(np.bincount(ic).max())  # the row itself is among the nearest
            scale = max(np.abs(x).max(), np.abs(y).max()) or 1.0
            xs, ys = (x / scale).astype(np.float32), (y / scale).astype(np.float32)
            yy = (ys * ys).sum(1)
            slack = 2 * (x.shape[1] + 8) * np.finfo(np.float32).eps * ((xs * xs).sum(1) + yy.max())
            ys *= -2
            for a in range(0, len(x), 256):
                own, more = xs[a : a + 256], slack[a : a + 256]
                bound = np.full(len(own), np.inf, np.float32)
                r, c, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
                for b in range(0, len(y), 8192):
                    near = own @ ys[b : b + 8192].T
                    near += yy[b : b + 8192]
                    if b == 0 and near.shape[1] >= most:
                        bound = np.partition(near[:, : max(1024, most)], most - 1, axis=1)[:, most - 1]
                    at, to = np.nonzero(near <= (bound + more)[:, None])
                    r, c, d = np.r_[r, at], np.r_[c, to + b], np.r_[d, near[at, to]]
                    order = np.lexsort((d, r))
                    r, c, d = r[order], c[order], d[order]
                    last = np.searchsorted(r, np.arange(len(own))) + most - 1
                    full = last < np.searchsorted(r, np.arange(len(own)), "right")
                    bound[full] = np.minimum(bound[full], d[last[full]])
                    kept = d <= (bound + more)[r]
                    r, c, d = r[kept], c[kept], d[kept]
                r = r + a
                other = qc[r] != ic[c]
                r, c = r[other], c[other]
                far = np.zeros(len(r))
                for j in range(x.shape[1]):
                    step = x[r, j] - y[c, j]
                    far += step * step
                far = np.sqrt(far)
                order = np.lexsort((c, far, r))
                order = order[np.isfinite(far[order])]
                first = np.searchsorted(r[order], r[order])
                order = order[np.arange(len(order)) - first < k]
                found.append((r[order], c[order], far[order]))
        r, c, far = (np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"q": q.column("k").take(pa.array(r)), "i": i.column("k").take(pa.array(c)), "label": i.column("label").take(pa.array(c)), "d": far})

    near = both.groupBy("qb", "ib").applyInArrow(nearest, f"q {kind}, i {kind}, label string, d double")
    top = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "i"))).filter(F.col("r") <= k)
    return top.groupBy(F.col("q").alias(key), F.col("label").cast(dict(df.dtypes)[label]).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_means(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, pos, mean, scatter): per class and dimension the mean and the sum of squared deviations."""
    e = df.select(label, F.posexplode(vector).alias("pos", "v"))
    return e.groupBy(label, "pos").agg(F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("scatter"))


def lda(df: DataFrame, vector: str, label: str, components: int, reg: float = 5e-5) -> list[list[float]]:
    """Projection rows of linear discriminant analysis. Every batch of vectors gives the dim x dim products of each class once;
    these are summed. Null vectors are left out."""
    import numpy as np
    import pyarrow as pa

    rows = df.filter(F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["label"].dataType.simpleString()

    def products(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array(batch.column(0).to_pylist(), dtype=object)
            x = np.stack([np.asarray(v) for v in batch.column(1).to_numpy(zero_copy_only=False)])
            d = x.shape[1]
            for c in dict.fromkeys(own.tolist()):
                part = x[own == c]
                # row d holds the sums, its last place the count
                moments = np.vstack([np.hstack([part.T @ part, np.zeros((d, 1))]), np.r_[part.sum(0), len(part)]])
                i, j = np.indices(moments.shape)
                yield pa.RecordBatch.from_arrays([pa.array([c] * moments.size, batch.column(0).type), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(moments.ravel())], names=["label", "i", "j", "s"])

    sums = rows.mapInArrow(products, f"label {kind}, i int, j int, s double").groupBy("label", "i", "j").agg(F.sum("s").alias("s")).collect()  # dim x dim numbers a class
    dim = max(r["i"] for r in sums)
    first: dict = {}
    second = [r for r in sums if r["i"] < dim and r["j"] < dim]
    n = {r["label"]: r["s"] for r in sums if r["i"] == dim and r["j"] == dim}
    for r in sums:
        if r["i"] == dim and r["j"] < dim:
            first.setdefault(r["label"], np.zeros(dim))[r["j"]] = r["s"]
    classes = sorted(n)
    mean = {c: first[c] / n[c] for c in classes}
    total = sum(n.values())
    overall = sum(n[c] * mean[c] for c in classes) / total
    within = np.zeros((dim, dim))
    for r in second:
        within[r["i"], r["j"]] += r["s"]
    within = (within - sum(n[c] * np.outer(mean[c], mean[c]) for c in classes)) / total + reg * np.eye(dim)
    between = sum(n[c] * np.outer(mean[c] - overall, mean[c] - overall) for c in classes) / total
    lower = np.linalg.inv(np.linalg.cholesky(within))
    value, axis = np.linalg.eigh(lower @ between @ lower.T)
    return (axis[:, np.argsort(-value)[:components]].T @ lower).tolist()


def project(df: DataFrame, vector: str, rows: list[list[float]], out: str = "lda") -> DataFrame:
    dot = lambda w: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn(out, F.array(*map(dot, rows)))
