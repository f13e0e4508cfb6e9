"""Text feature frames and child-to-parent pooling."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordinalis.functions import text as T
from ordinalis.functions import vectors as V
from ordinalis.operators import knn
from ordinalis.session import cut


def text_features(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and all hand features of ``text``; null text counts as empty. One pass, no shuffle, no Python."""
    low = df.select(key, text, T.matchable(text).alias("__low"))
    frame = low.select(key, *(c.alias(n) for n, c in (T.meta_features(text) | T.keyword_features(F.col("__low")) | T.parsed_features(text, F.col("__low"))).items()))
    return frame.withColumn("type_text", F.signum(F.col("kw_dog") - F.col("kw_cat")).cast("int"))


def pool_children(children: DataFrame, parent: str | list[str], order: list[str], columns: list[str]) -> DataFrame:
    """First (by ``order``, first non-null), mean and max of every column per parent, suffixed ``_first``, ``_mean`` and ``_max``."""
    place = F.struct(*order)
    aggregates: list[Column] = []
    for c in columns:
        aggregates += [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"{c}_first"), F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")]
    return children.groupBy(parent).agg(*aggregates)


def pool_vectors(children: DataFrame, parent: str, order: list[str], vector: str) -> DataFrame:
    """(parent, n, first_vector, mean_vector): the first child's vector as it is, and the mean brought to unit length. Unusable
    vectors do not count; sums combine before the shuffle, so a parent with very many children is no problem."""
    good = children.where(V.usable(vector))
    summed = good.groupBy(parent).agg(F.count("*").alias("n"), F.min_by(vector, F.struct(*order)).alias("first_vector"), Summarizer.mean(array_to_vector(vector)).alias("__mean"))
    return summed.withColumn("__mean", vector_to_array("__mean")).select(parent, "n", "first_vector", V.unit("__mean").alias("mean_vector"))


def bags(children: DataFrame, parent: str, order: list[str], vector: str, size: int = 12) -> DataFrame:
    """(parent, n, bag): the first ``size`` vectors in order, and the number of all children. Filtering on the rank right above the
    window lets Spark keep only ``size`` rows per parent and task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(parent).orderBy(*order))
    kept = children.select(parent, *order, vector).withColumn("slot", rank).where(F.col("slot") <= size)
    packed = kept.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct("slot", vector))).alias("b"))
    counts = children.groupBy(parent).agg(F.count("*").alias("n"))
    return packed.join(counts, parent).select(parent, "n", F.col(f"b.{vector}").alias("bag"))


def attention_pool(bag: DataFrame, parent: str, v: list[list[float]], u: list[list[float]], w: list[float]) -> DataFrame:
    """(parent, weights, pooled) of a gated attention over bags: softmax of w.(tanh(V h) * sigmoid(U h)) over the bag's slots, and
    the weighted sum of its vectors with log(1 + n) appended."""
    lit = lambda rows: F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in rows))

    def gate(h: Column) -> Column:
        left = F.transform(lit(v), lambda row: F.tanh(V.dot(row, h)))
        right = F.transform(lit(u), lambda row: 1 / (1 + F.exp(-V.dot(row, h))))
        return V.dot(F.array(*(F.lit(float(x)) for x in w)), F.zip_with(left, right, lambda a, b: a * b))

    scored = bag.withColumn("s", F.transform("bag", gate)).withColumn("e", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    weighed = scored.withColumn("weights", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)))
    zero = F.transform(F.col("bag")[0], lambda x: F.lit(0.0))
    pairs = F.arrays_zip("weights", "bag")
    pooled = F.aggregate(pairs, zero, lambda acc, p: F.zip_with(acc, p["bag"], lambda a, x: a + p["weights"] * x.cast("double")))
    return weighed.select(parent, "weights", F.concat(pooled, F.array(F.log1p("n"))).alias("pooled"))


def zero_shot(items: DataFrame, key: str, vector: str, prototypes: DataFrame, scale: float = 100.0) -> DataFrame:
    """(key, grp, label, p): softmax of scale * cosine within each group of labels.

    ``prototypes`` has grp, label and prompt vectors; a label's prompts are averaged and normalised first. The prototypes are a
    dictionary of prompts (tens of rows, at most 10,000), packed into one row a group; every item meets every group by a keyless join of
    that bounded size.
    """
    table = prototypes.where(V.usable("vector")).groupBy("grp", "label").agg(vector_to_array(Summarizer.mean(array_to_vector(V.unit("vector")))).alias("m")).select("grp", "label", V.unit("m").alias("m"))
    count = table.limit(10_001).count()
    if count > 10_000:
        raise ValueError("zero_shot takes a dictionary of prompts, at most 10,000 labels")
    packed = table.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("label", "m"))).alias("labels"))
    rows = items.where(V.usable(vector)).select(key, V.unit(vector).alias("__v")).join(F.broadcast(packed))
    logits = rows.select(key, "grp", F.transform("labels", lambda x: F.struct(x["label"].alias("label"), (F.lit(scale) * V.dot(F.col("__v"), x["m"])).alias("z"))).alias("l"))
    top = logits.withColumn("top", F.array_max("l.z"))
    exps = top.select(key, "grp", F.transform("l", lambda x: F.struct(x["label"].alias("label"), F.exp(x["z"] - F.col("top")).alias("e"))).alias("l"))
    total = exps.withColumn("total", F.aggregate("l.e", F.lit(0.0), lambda a, x: a + x))
    return total.select(key, "grp", "total", F.explode("l").alias("x")).select(key, "grp", F.col("x.label").alias("label"), (F.col("x.e") / F.col("total")).alias("p"))


def prefixed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """``df`` with ``prefix`` before the name of every column but ``keep``."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def encoder_bundle(tag: str, photos: DataFrame, listings: DataFrame, prototypes: DataFrame, texts: DataFrame | None = None, *, k: int = 5, scale: float = 100.0) -> DataFrame:
    """All features of one encoder per listing, named ``tag``_...: zero-shot probabilities of every photo pooled to first, mean and max
    (zs_group_label_...), out-of-fold neighbour targets of the pooled vector (img_...), and the similarity of the listing's text to the
    mean and the first photo (txt_img_...) where ``texts`` is given.

    ``photos`` has PetID, img_idx, path (each once) and img_emb, ``listings`` PetID (each once), y (null where unknown) and fold,
    ``prototypes`` grp, label and vector, ``texts`` PetID and vector. Listings without a usable photo keep their row, with nulls.
    """
    good = cut(photos.where(V.usable("img_emb")).select("PetID", "img_idx", "path", "img_emb"))
    labels = [tuple(r) for r in prototypes.select("grp", "label").distinct().orderBy("grp", "label").limit(10_000).collect()]  # a dictionary
    shares = zero_shot(good, "path", "img_emb", prototypes, scale).join(good.select("path", "PetID", "img_idx").hint("merge"), "path")
    pooled = pool_children(shares, ["PetID", "grp", "label"], ["img_idx", "path"], ["p"])
    pick = lambda g, name, a: F.max(F.when((F.col("grp") == g) & (F.col("label") == name), F.col(f"p_{a}"))).alias(f"zs_{g}_{name}_{a}")
    wide = pooled.groupBy("PetID").agg(*(pick(g, name, a) for g, name in labels for a in ("first", "mean", "max")))
    vectors = cut(pool_vectors(good, "PetID", ["img_idx", "path"], "img_emb").drop("n"))
    placed = listings.join(vectors.hint("merge"), "PetID")
    queries = cut(placed.select(F.col("PetID").alias("q"), F.col("mean_vector").alias("vec"), "fold", F.lit(True).alias("valid")))
    found = knn.knn_join(queries, placed.where("y is not null").select(F.col("PetID").alias("r"), F.col("mean_vector").alias("vec"), "fold", "y"), k)
    near = prefixed(knn.knn_target(found, queries), "img_", "q").withColumnRenamed("q", "PetID")
    out = listings.select("PetID").join(wide, "PetID", "left").join(near, "PetID", "left")
    if texts is not None:
        both = vectors.join(texts.select("PetID", F.col("vector").alias("__t")), "PetID")
        out = out.join(both.select("PetID", V.dot("__t", "mean_vector").alias("txt_img_mean"), V.dot("__t", "first_vector").alias("txt_img_first")), "PetID", "left")
    return prefixed(out, f"{tag}_", "PetID")
