"""The registered queries of the core, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinalis.functions import text as T
from ordinalis.functions import vectors as V
from ordinalis.operators import features as O
from ordinalis.operators import folds, knn, metrics, models, sparse, tables, tfidf
from ordinalis.session import cut
from ordinalis.sources import files
from ordinalis.sources.tables import canonical_id, pad_id, table

Query = Callable[[SparkSession, str], DataFrame]
AGE_EDGES = [0.0, 2.0, 4.0, 6.0, 12.0, 24.0, 300.0]


def _listings(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One row per pet: the latest load of each canonical id, ties by text; the label is null for test."""
    rows = table(spark, folder, split).select(canonical_id("PetID").alias("PetID"), "Description", (F.col("AdoptionSpeed") if split == "train" else F.lit(None).cast("int")).alias("AdoptionSpeed"), "source", "loaded_at")
    best = F.max_by(F.struct("Description", "AdoptionSpeed", "source"), F.struct("loaded_at", F.coalesce("Description", F.lit("")))).alias("r")
    return rows.where("PetID is not null").groupBy("PetID").agg(best).select("PetID", "r.Description", "r.AdoptionSpeed", "r.source")


def _both(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda s: _listings(spark, folder, s).withColumn("split", F.lit(s))
    return part("train").unionByName(part("test"))


def _photos(spark: SparkSession, folder: str, encoder: str = "clip") -> DataFrame:
    """Photos with a readable name, once each, with the encoder's vector where there is a usable one."""
    names = files.index_photos(table(spark, folder, "image_index").select("path").distinct())
    vectors = table(spark, folder, f"{encoder}_img_emb").groupBy("path").agg(F.max(F.when(V.usable("img_emb"), F.col("img_emb"))).alias("img_emb"))
    return names.join(vectors, "path", "left")


def knn_target_oof(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.col("label").alias("y"), F.pmod("vec_id", F.lit(5)).cast("int").alias("fold"))
    queries = rows.select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec"), "fold", F.lit(True).alias("valid"))
    found = knn.knn_join(queries, rows.select(F.col("vec_id").alias("r"), F.col("embedding").alias("vec"), "fold", "y"), 5)
    out = knn.knn_target(found, queries)
    return out.select(F.col("q").alias("vec_id"), F.round("knn_y", 6).alias("knn_y"), "nn1_y", F.round("nn1_sim", 6).alias("nn1_sim"), F.round("knn_mean_sim", 6).alias("knn_mean_sim"))


def listings(spark: SparkSession, folder: str) -> DataFrame:
    return _both(spark, folder).select("PetID", "split", T.filled("Description").alias("text"), "AdoptionSpeed", (F.length(T.normalized("Description")) >= 5).cast("int").alias("valid"))


def padded_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "test").select("PetID").distinct().select("PetID", pad_id("PetID").alias("padded"), F.length("PetID").cast("long").alias("width"))


def image_index(spark: SparkSession, folder: str) -> DataFrame:
    return files.index_photos(table(spark, folder, "image_index").select("path").distinct())


def photo_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.add_child_count(_both(spark, folder), image_index(spark, folder), "PetID").select("PetID", "split", "n_photos")



def photoless_share(spark: SparkSession, folder: str) -> DataFrame:
    counted = tables.add_child_count(_both(spark, folder), image_index(spark, folder), "PetID")
    return counted.groupBy("split").agg(F.round(F.avg((F.col("n_photos") == 0).cast("double")), 9).alias("share"), F.count("*").alias("n"))


def orphan_photos(spark: SparkSession, folder: str) -> DataFrame:
    """Photos whose pet has no listing."""
    return image_index(spark, folder).join(_both(spark, folder).select("PetID"), "PetID", "left_anti").groupBy("split").agg(F.count("*").alias("n_photos"), F.countDistinct("PetID").alias("n_pets"))


def text_meta(spark: SparkSession, folder: str) -> DataFrame:
    f = O.text_features(_both(spark, folder), "PetID", "Description")
    rounded = ("desc_upper_ratio", "desc_non_ascii", "cjk_ratio")
    return f.select("PetID", *(F.round(c, 9).alias(c) if c in rounded else F.col(c) for c in ("desc_len", "desc_words", "desc_upper_ratio", "desc_excl", "desc_digits", "desc_is_empty", "desc_non_ascii", "cjk_ratio", "n_sentences")))


def text_keywords(spark: SparkSession, folder: str) -> DataFrame:
    f = O.text_features(_both(spark, folder), "PetID", "Description")
    return f.select("PetID", *T.KEYWORDS, "malay_words", "type_text")


def age_and_count(spark: SparkSession, folder: str) -> DataFrame:
    f = O.text_features(_both(spark, folder), "PetID", "Description")
    return f.select("PetID", F.round("age_months", 9).alias("age_months"), "age_missing", "pet_count")


def normalized_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _both(spark, folder).select("PetID", T.normalized("Description").alias("norm"), F.substring(T.filled("Description"), 1, 300).alias("head"))


def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    return folds.stratified_folds(_listings(spark, folder, "train"), "AdoptionSpeed", "PetID").select("PetID", "AdoptionSpeed", "fold")


def class_sample(spark: SparkSession, folder: str) -> DataFrame:
    return folds.sample_per_class(_listings(spark, folder, "train").where("AdoptionSpeed is not null"), "AdoptionSpeed", "PetID", 10, 7).select("PetID", "AdoptionSpeed")


def subsample_means(spark: SparkSession, folder: str) -> DataFrame:
    rows = _listings(spark, folder, "train").where("AdoptionSpeed is not null").select("PetID", "AdoptionSpeed")
    draws = folds.subsamples(rows, "PetID", 20, 50, 3)
    return draws.groupBy("draw").agg(F.count("*").alias("n"), F.round(F.avg("AdoptionSpeed"), 9).alias("mean_speed"))


def _numbered(column: str, out: str):
    """Position and value of a vector's coordinates, as the two columns ``pos`` and ``out``."""
    return F.posexplode(F.transform(column, lambda x: x.cast("double"))).alias("pos", out)


def photo_pooling(spark: SparkSession, folder: str) -> DataFrame:
    """First, mean and largest value of every coordinate over the photos of a pet."""
    rows = _photos(spark, folder).where("img_emb is not null").select("PetID", "img_idx", "path", _numbered("img_emb", "v"))
    pooled = O.pool_children(rows, ["PetID", "pos"], ["img_idx", "path"], ["v"])
    return pooled.select("PetID", "pos", *(F.round(f"v_{a}", 6).alias(f"v_{a}") for a in ("first", "mean", "max")))


def pet_vectors(spark: SparkSession, folder: str) -> DataFrame:
    pooled = O.pool_vectors(_photos(spark, folder), "PetID", ["img_idx", "path"], "img_emb")
    both = pooled.select("PetID", "n", F.posexplode(F.arrays_zip("first_vector", "mean_vector")).alias("pos", "v"))
    return both.select("PetID", "n", "pos", F.round(F.col("v.first_vector").cast("double"), 6).alias("first"), F.round("v.mean_vector", 6).alias("mean"))


def first_mean_similarity(spark: SparkSession, folder: str) -> DataFrame:
    pooled = O.pool_vectors(_photos(spark, folder), "PetID", ["img_idx", "path"], "img_emb")
    return pooled.select("PetID", F.round(V.cosine("first_vector", "mean_vector"), 6).alias("sim"))


def photo_bags(spark: SparkSession, folder: str) -> DataFrame:
    bag = O.bags(_photos(spark, folder).where(V.usable("img_emb")), "PetID", ["img_idx", "path"], "img_emb")
    slots = bag.select("PetID", "n", F.posexplode("bag").alias("slot", "v"))
    return slots.select("PetID", "n", "slot", *(F.round(F.aggregate("v", F.lit(0.0), f), 6).alias(name) for name, f in (("total", lambda s, x: s + x.cast("double")), ("squares", lambda s, x: s + x.cast("double") * x.cast("double")))))


def attention_pooling(spark: SparkSession, folder: str) -> DataFrame:
    bag = O.bags(_photos(spark, folder).where(V.usable("img_emb")), "PetID", ["img_idx", "path"], "img_emb")
    unit = lambda k: [1.0 if j == k else 0.0 for j in range(64)]
    pooled = O.attention_pool(bag, "PetID", [unit(0), unit(1)], [unit(2), unit(3)], [1.0, -1.0])
    return pooled.select("PetID", F.round(F.col("weights")[0], 6).alias("first_weight"), F.posexplode("pooled").alias("pos", "p")).withColumn("p", F.round("p", 6))


def attention_by_slot(spark: SparkSession, folder: str) -> DataFrame:
    bag = O.bags(_photos(spark, folder).where(V.usable("img_emb")), "PetID", ["img_idx", "path"], "img_emb").where("n >= 5")
    unit = lambda k: [1.0 if j == k else 0.0 for j in range(64)]
    pooled = O.attention_pool(bag, "PetID", [unit(0), unit(1)], [unit(2), unit(3)], [1.0, -1.0])
    return pooled.select(F.posexplode("weights").alias("slot", "w")).groupBy("slot").agg(F.round(F.avg("w"), 6).alias("mean_weight"), F.count("*").alias("n"))


def zero_shot(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    prompts = rows.select(F.concat(F.lit("g"), F.pmod("label", F.lit(2)).cast("string")).alias("grp"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("label"), F.col("embedding").alias("vector"))
    found = O.zero_shot(rows.select("vec_id", "embedding"), "vec_id", "embedding", prompts)
    return found.select("vec_id", "grp", "label", F.round("p", 6).alias("p"))


def tfidf_char(spark: SparkSession, folder: str) -> DataFrame:
    docs = _listings(spark, folder, "train").select("PetID", T.normalized("Description").alias("t"))
    postings = tfidf.tfidf(tfidf.char_terms(docs, "PetID", F.col("t")), "PetID", docs.count(), 2)
    return postings.groupBy("PetID").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("largest"))


def tfidf_word(spark: SparkSession, folder: str) -> DataFrame:
    docs = _listings(spark, folder, "train").select("PetID", T.matchable("Description").alias("t"))
    postings = tfidf.tfidf(tfidf.word_terms(docs, "PetID", F.col("t")), "PetID", docs.count(), 3, 50_000)
    return postings.groupBy("PetID").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("largest"))


def _word_char(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, pd.DataFrame]:
    """The listings of both splits, the numbers and weights of their terms, and the vocabulary."""
    docs = _both(spark, folder).select(F.concat_ws(":", "split", "PetID").alias("id"), "Description")
    return docs, *tfidf.word_char_rows(docs, "id", F.lower(T.filled("Description")), T.normalized("Description"), docs.count())


def tfidf_word_char(spark: SparkSession, folder: str) -> DataFrame:
    """Both blocks side by side over the texts of train and test: every term of every text with its weight."""
    _, rows, vocabulary = _word_char(spark, folder)
    weight = F.rint(F.col("weight") * 1e6) / 1e6  # to six places; round() would make a decimal number of each
    return tfidf.flat_rows(rows, "id", vocabulary).select("id", "term", "df", weight.alias("weight"))


def text_components(spark: SparkSession, folder: str) -> DataFrame:
    docs, rows, vocabulary = _word_char(spark, folder)
    made = tfidf.svd_rows(rows, len(vocabulary), docs, "id", 64)
    return made.select("id", *(F.round(F.abs(F.col("projected")[k]), 5).alias(f"svd_{k}") for k in range(64)))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return cut(_both(spark, folder).select("PetID", T.normalized("Description").alias("t")).groupBy("PetID").agg(F.min("t").alias("t")))


def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return tfidf.duplicate_groups(_texts(spark, folder), "PetID", "t", 0.9)[0]


def duplicate_sweep(spark: SparkSession, folder: str) -> DataFrame:
    thresholds = (0.9, 0.92, 0.95, 0.98)
    labels = _listings(spark, folder, "train").select("PetID", "AdoptionSpeed")
    groups = tfidf.groups_at(_texts(spark, folder), "PetID", "t", thresholds)
    return tfidf.threshold_sweep(groups, thresholds, "PetID", labels, "AdoptionSpeed").select("threshold", "n_multi", "n_groups", "largest", F.round("mean_std", 6).alias("mean_std"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled listings with a stand-in score made from their text."""
    rows = _listings(spark, folder, "train").where("AdoptionSpeed is not null")
    f = rows.select("PetID", F.col("AdoptionSpeed").alias("y"), "source", F.length(T.filled("Description")).alias("n"))
    return f.withColumn("score", 1 + 3 * F.pmod("n", F.lit(97)) / 96.0).withColumn("p", metrics.round_labels(F.col("score"), 1, 4))


def kappa(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).agg(F.round(metrics.qwk("y", "p"), 9).alias("qwk"), F.round(metrics.rmse("y", "score"), 9).alias("rmse"), F.round(metrics.agreement("y", "p"), 9).alias("agree"))


def rater_kappa(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "reading_labels").where("band is not null").select("doc_id", "rater", "band").distinct()
    a, b = (rows.select("doc_id", F.col("rater").alias(f"rater_{x}"), F.col("band").alias(f"band_{x}")) for x in "ab")
    return a.join(b, "doc_id").where("rater_a < rater_b").groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"), F.round(metrics.qwk("band_a", "band_b"), 9).alias("qwk"))


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(_scored(spark, folder), "y", "p", [1, 2, 3, 4]).select("y", "p", "n", F.round("share", 9).alias("share"))


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder).select((F.col("y") >= 3).cast("int").alias("l"), "score")
    return metrics.auc(rows, "l", "score").select(F.round("auc", 9).alias("auc"))


def spearman(spark: SparkSession, folder: str) -> DataFrame:
    rows = O.text_features(_listings(spark, folder, "train").where("AdoptionSpeed is not null"), "PetID", "Description").join(_listings(spark, folder, "train").select("PetID", "AdoptionSpeed"), "PetID")
    return metrics.spearman(rows, ["desc_len", "desc_words", "age_months", "pet_count", "kw_cat", "n_sentences"], "AdoptionSpeed").select("feature", F.round("rho", 6).alias("rho"))


def pearson(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.pearson_matrix(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("a", "b", F.round("r", 6).alias("r"))


def cut_labels(spark: SparkSession, folder: str) -> DataFrame:
    label = metrics.apply_cuts(F.col("score"), [1.5, 2.5, 3.5])
    return _scored(spark, folder).select(label.alias("label"), "p").groupBy("label", "p").agg(F.count("*").alias("n"))


def split_drift(spark: SparkSession, folder: str) -> DataFrame:
    both = _both(spark, folder)
    f = both.select("split", *(c.alias(n) for n, c in T.meta_features("Description").items()))
    return metrics.drift(f, "split", ["desc_len", "desc_words", "desc_excl", "desc_digits"]).select("feature", F.round("train_mean", 6).alias("train_mean"), F.round("test_mean", 6).alias("test_mean"), F.round("diff_pct", 6).alias("diff_pct"))


def speed_shares(spark: SparkSession, folder: str) -> DataFrame:
    return tables.value_shares(_listings(spark, folder, "train"), "AdoptionSpeed").select("AdoptionSpeed", "n", F.round("share", 9).alias("share"))


def speed_by_age(spark: SparkSession, folder: str) -> DataFrame:
    rows = _listings(spark, folder, "train").where("AdoptionSpeed is not null")
    aged = rows.select("AdoptionSpeed", T.age_months(T.matchable("Description")).alias("age")).select("AdoptionSpeed", tables.right_closed_bin(F.col("age"), AGE_EDGES).alias("age_bin"))
    return aged.where("age_bin is not null").groupBy("age_bin").agg(F.count("*").alias("n"), F.round(F.avg("AdoptionSpeed"), 9).alias("mean_speed"))


def source_by_speed(spark: SparkSession, folder: str) -> DataFrame:
    return tables.cross_table(_listings(spark, folder, "train"), "source", "AdoptionSpeed")


def feature_profile(spark: SparkSession, folder: str) -> DataFrame:
    f = O.text_features(_both(spark, folder), "PetID", "Description")
    out = tables.describe(f, ["desc_len", "desc_words", "kw_cat"])
    return out.select("feature", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "median", "q999", "max")))


def source_means(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder)
    return rows.groupBy("source").agg(F.round(F.avg("n"), 3).alias("mean_len"), F.round(F.avg("score"), 6).alias("mean_score"), F.countDistinct("n").alias("n_lengths"))


def length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return tables.histogram(_both(spark, folder).select(F.length(T.filled("Description")).alias("n")), "n", 0.0, 1000.0, 20)


def speed_spread(spark: SparkSession, folder: str) -> DataFrame:
    rows = _listings(spark, folder, "train").where("AdoptionSpeed is not null").select(F.sha2(T.normalized("Description"), 256).alias("g"), "AdoptionSpeed")
    out = tables.spread_in_groups(rows, "g", "AdoptionSpeed")
    return out.select("n_multi", F.round("mean_group_std", 6).alias("mean_group_std"), F.round("global_std", 6).alias("global_std"))


def largest_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = _both(spark, folder).select("PetID", "split", T.normalized("Description").alias("norm"))
    return tables.members_of_largest(rows, "norm").select("PetID", "split")


def texts_in_both(spark: SparkSession, folder: str) -> DataFrame:
    both = _both(spark, folder).select("split", "PetID", T.normalized("Description").alias("norm"))
    test, train = both.where("split = 'test'"), both.where("split = 'train'")
    return test.join(train.select("norm"), "norm", "left_semi").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("n_texts"))


def photo_pets_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Both differences of the id sets of photos and listings."""
    a, b = image_index(spark, folder).select("PetID").distinct(), _both(spark, folder).select("PetID").distinct()
    return a.exceptAll(b).select("PetID", F.lit("no listing").alias("missing")).unionByName(b.exceptAll(a).select("PetID", F.lit("no photo").alias("missing")))


def submission(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "test").groupBy(canonical_id("PetID").alias("id")).agg(F.min("PetID").alias("PetID")).select("PetID")
    predictions = raw.select(pad_id("PetID").alias("PetID"), (1 + F.pmod(F.length("PetID"), F.lit(4))).alias("pred"))
    return files.submission(raw, predictions)


def top_photos(spark: SparkSession, folder: str) -> DataFrame:
    return _photos(spark, folder).where("img_emb is not null").select("path", F.round(F.col("img_emb")[0].cast("double"), 6).alias("score")).orderBy(F.desc("score"), "path").limit(4)


def photo_joins(spark: SparkSession, folder: str) -> DataFrame:
    """Listings with their pooled photo features and counts, through the three joins of the feature frame."""
    both = tables.add_child_count(_both(spark, folder), image_index(spark, folder), "PetID")
    pooled = O.pool_children(_photos(spark, folder).select("PetID", "img_idx", "path", F.col("img_emb")[0].cast("double").alias("v0")), "PetID", ["img_idx", "path"], ["v0"])
    return both.join(pooled, "PetID", "left").groupBy("split").agg(F.count("*").alias("n"), F.sum("n_photos").alias("photos"), F.count("v0_mean").alias("with_vector"), F.round(F.avg("v0_mean"), 6).alias("mean"))


def _model_frame(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    both = _both(spark, folder)
    f = O.text_features(both, "PetID", "Description").join(both.groupBy("PetID").agg(F.max("AdoptionSpeed").alias("AdoptionSpeed")), "PetID").dropDuplicates(["PetID"])
    columns = [c for c in f.columns if c not in ("PetID", "AdoptionSpeed")]
    return cut(folds.stratified_folds(f, "AdoptionSpeed", "PetID")), columns


def ridge_oof(spark: SparkSession, folder: str) -> DataFrame:
    frame, columns = _model_frame(spark, folder)
    out = models.out_of_fold(models.assemble(frame, columns), "PetID", "AdoptionSpeed", lambda t: models.ridge(t, "AdoptionSpeed", models.ALPHAS["clip_text"]))
    return out.select("PetID", "fold", F.round("pred", 6).alias("pred"))


def subsample_kappa(spark: SparkSession, folder: str) -> DataFrame:
    """The kappa of 3,000 draws at 10, 20, 30 and 50 % of the reference's 1,891 test rows."""
    frame, columns = _model_frame(spark, folder)
    out = models.out_of_fold(models.assemble(frame, columns), "PetID", "AdoptionSpeed", lambda t: models.ridge(t, "AdoptionSpeed", models.ALPHAS["clip_text"]))
    known = cut(out.where(F.col("AdoptionSpeed").isNotNull()))
    label = metrics.apply_cuts(F.col("pred"), metrics.optimise_cuts(known, "pred", "AdoptionSpeed")).alias("label")
    return folds.subsample_kappas(known.select("AdoptionSpeed", label).groupBy("AdoptionSpeed", "label").agg(F.count("*").alias("n")), "AdoptionSpeed", "label", 3000, (189, 378, 567, 946), 0)


def _level1(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str], dict[str, DataFrame]]:
    """The model frame and the out-of-fold ridge predictions over photo vectors of both encoders and over both blocks of TF-IDF."""
    frame, columns = _model_frame(spark, folder)
    base = frame.select("PetID", "AdoptionSpeed", "fold")
    out = {}
    for tag in ("clip", "siglip"):
        pooled = O.pool_vectors(_photos(spark, folder, tag), "PetID", ["img_idx", "path"], "img_emb")
        ready = base.join(pooled.select("PetID", array_to_vector("mean_vector").alias("features")), "PetID")
        out[f"{tag}_img"] = models.out_of_fold(ready, "PetID", "AdoptionSpeed", lambda t, a=models.ALPHAS[f"{tag}_img"]: models.ridge(t, "AdoptionSpeed", a))
    docs = _both(spark, folder).groupBy("PetID").agg(F.min("Description").alias("d"))
    docs = docs.join(base, "PetID").select(F.struct("PetID", "AdoptionSpeed", "fold").alias("doc"), "d")  # before the terms are made, which are far larger
    rows, vocabulary = tfidf.word_char_rows(docs, "doc", T.matchable("d"), T.normalized("d"), docs.count(), empty=True)
    out["tfidf"] = sparse.ridge_oof(rows.select("doc.*", "i", "w"), "PetID", "AdoptionSpeed", len(vocabulary), models.ALPHAS["tfidf"])
    return frame, columns, {name: cut(f) for name, f in out.items()}


def level1(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge with the penalty of its kind over the photo vectors of each encoder and over TF-IDF."""
    parts = [f.select("PetID", F.lit(name).alias("model"), "fold", F.round("pred", 4).alias("pred")) for name, f in _level1(spark, folder)[2].items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ridge_one(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold ridge on the length of the text alone, which has a closed form."""
    frame, _ = _model_frame(spark, folder)
    out = models.out_of_fold(models.assemble(frame, ["desc_len"]), "PetID", "AdoptionSpeed", lambda t: models.ridge(t, "AdoptionSpeed", 3.0))
    return out.select("PetID", "fold", F.round("pred", 6).alias("pred"))


def stacked(spark: SparkSession, folder: str) -> DataFrame:
    frame, columns, first = _level1(spark, folder)
    hand = models.out_of_fold(models.assemble(frame, columns), "PetID", "AdoptionSpeed", lambda t: models.ridge(t, "AdoptionSpeed", 3.0))
    final = models.stack({**first, "hand": cut(hand)}, frame, "PetID", "AdoptionSpeed", columns, seeds=(42, 43, 44, 45, 46))
    return models.honest_labels(final, "AdoptionSpeed").select("PetID", "fold", "label", F.round("pred", 6).alias("pred"))


def boosted_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Gain of every text feature, averaged over folds that stop by their own rows, and that of the refit sized by their best rounds."""
    frame, columns = _model_frame(spark, folder)
    ready = cut(models.assemble(frame, columns))
    made = models.boosted(ready, "PetID", "AdoptionSpeed", columns, rounds=40, patience=5, step=20, depth=4)
    refit = dict(models.importance(models.full_refit(ready, "AdoptionSpeed", made["best_rounds"], depth=4), columns))
    return spark.createDataFrame([(name, gain, refit[name]) for name, gain in made["importance"]], "feature string, gain double, refit_gain double")


def run_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Honest kappa of two runs and of their mean, the gain over the first, and whether it passes."""
    frame, columns = _model_frame(spark, folder)
    run = lambda cols: cut(models.out_of_fold(models.assemble(frame, cols), "PetID", "AdoptionSpeed", lambda t: models.ridge(t, "AdoptionSpeed", 3.0)))
    a, b = run(columns), run(columns[:7])
    both = models.ensemble([a, b], "PetID").join(a.drop("pred"), "PetID")
    rows = models.gate({"all": ("A", a), "meta": ("B", b), "mean": ("C", both)}, "all", "AdoptionSpeed")
    return spark.createDataFrame([(n, round(q, 6), round(g, 6), ok) for n, q, g, ok in rows], "run string, qwk double, gain double, accepted boolean")


def blended(spark: SparkSession, folder: str) -> DataFrame:
    frame, columns = _model_frame(spark, folder)
    part = lambda cols: cut(models.out_of_fold(models.assemble(frame, cols), "PetID", "AdoptionSpeed", lambda t: models.ridge(t, "AdoptionSpeed", 3.0)))
    out = models.blend({"meta": part(columns[:7]), "words": part(columns[7:])}, frame, "PetID", "AdoptionSpeed")
    return out.select("PetID", "fold", F.round("pred", 6).alias("pred"))


def column_ablation(spark: SparkSession, folder: str) -> DataFrame:
    frame, columns = _model_frame(spark, folder)
    rows = models.ablation(frame, "PetID", "AdoptionSpeed", {"meta": columns[:7], "keywords": columns[7:28], "all": columns})
    return spark.createDataFrame([(n, k, round(v, 6)) for n, k, v in rows], "name string, n_columns int, qwk double")


def penalty_grid(spark: SparkSession, folder: str) -> DataFrame:
    frame, columns = _model_frame(spark, folder)
    rows = models.alpha_grid(models.assemble(frame, columns), "PetID", "AdoptionSpeed", (1.0, 3.0, 10.0))
    return spark.createDataFrame([(a, round(v, 6)) for a, v in rows], "alpha double, qwk double")


def adversarial_auc(spark: SparkSession, folder: str) -> DataFrame:
    both = _both(spark, folder)
    f = O.text_features(both, "PetID", "Description").join(both.groupBy("PetID").agg(F.max((F.col("split") == "test").cast("int")).alias("is_test")), "PetID").dropDuplicates(["PetID"])
    columns = [c for c in f.columns if c not in ("PetID", "is_test")]
    return models.adversarial(cut(folds.stratified_folds(f, "is_test", "PetID", n=5, seed=0)), "PetID", "is_test", columns)


def principal_components(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return models.project(rows, "vec_id", "features", 32).select("vec_id", *(F.round(F.abs(F.col("projected")[k]), 5).alias(f"p{k}") for k in range(32)))


def inner_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Listings, their photos and the photos' vectors through two inner joins, counted."""
    vectors = table(spark, folder, "clip_img_emb").where(V.usable("img_emb")).select("path").distinct()
    rows = _both(spark, folder).select("PetID", F.col("split").alias("listed"), "source").join(image_index(spark, folder), "PetID").join(vectors, "path")
    return rows.groupBy("listed", "source").agg(F.count("*").alias("n"), F.countDistinct("PetID").alias("n_pets"))


def photo_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The row of the ordered photo index that every vector belongs to; a vector without one would fail."""
    index = tables.positions(table(spark, folder, "image_index").where("path is not null").select("path").distinct(), ["path"])
    return tables.strict_lookup(table(spark, folder, "clip_img_emb").where("path is not null").select("path").distinct(), "path", index, "path", "position")


def length_boxes(spark: SparkSession, folder: str) -> DataFrame:
    f = _both(spark, folder).select("split", *(c.alias(n) for n, c in T.meta_features("Description").items()))
    return tables.box_plot(f, ["desc_len", "desc_words"], "split")


def length_density(spark: SparkSession, folder: str) -> DataFrame:
    out = tables.density(_both(spark, folder).select("split", F.length(T.filled("Description")).alias("n")), "n", "split", 0.0, 1000.0, 20)
    return out.select("split", "bin", "n", F.round("density", 9).alias("density"))


def text_knn_target(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbour targets of every text among the labelled texts of other folds, over character TF-IDF of train and test."""
    fold = folds.stratified_folds(_listings(spark, folder, "train").where("AdoptionSpeed is not null"), "AdoptionSpeed", "PetID").select(F.concat(F.lit("train:"), "PetID").alias("__id"), "fold")
    rows = _both(spark, folder).select(F.concat_ws(":", "split", "PetID").alias("id"), F.col("AdoptionSpeed").alias("y"), T.normalized("Description").alias("t"))
    docs = cut(rows.join(fold, F.col("id") == F.col("__id"), "left").select("id", "y", "fold", "t", (F.length("t") >= 5).alias("valid")))
    n = docs.count()
    vocabulary = tfidf.sent_vocabulary(docs.select(F.col("t").alias("chars")).repartition(n // knn.BLOCK + 1), 3, 5, 2)
    if vocabulary is not None:
        texts = docs.select(F.struct("id", "fold", "y", "valid").alias("id"), F.col("t").alias("chars")).repartition(n // knn.BLOCK + 1)
        rows = tfidf.packed_rows(texts, "id", vocabulary, n, 3, 5)
        found = knn.packed_knn_join(rows, "id", len(vocabulary), knn.dense_from(vocabulary["df"].to_numpy(), n), 5)
    else:
        found = knn.sparse_knn_join(tfidf.tfidf(tfidf.char_terms(docs, "id", F.col("t")), "id", n, 2), docs, "id", 5)
    out = knn.knn_target(found, docs.select(F.col("id").alias("q"), "valid"), k=5)
    return out.select(F.col("q").alias("id"), *(F.round(c, 6).alias(c) for c in ("knn_y", "nn1_y", "nn1_sim", "knn_mean_sim")))


def encoder_features(spark: SparkSession, folder: str) -> DataFrame:
    """The bundles of both encoders side by side; the photos at each place of a listing stand in for the prompts."""
    rows = _both(spark, folder).groupBy("PetID").agg(F.max("AdoptionSpeed").alias("y"))
    fold = folds.stratified_folds(rows.where("y is not null"), "y", "PetID").select("PetID", "fold")
    listings = cut(rows.join(fold, "PetID", "left"))
    out = listings.select("PetID")
    for tag in ("clip", "siglip"):
        photos = _photos(spark, folder, tag)
        prompts = photos.select(F.lit("slot").alias("grp"), F.least(F.greatest("img_idx", F.lit(1)), F.lit(3)).cast("string").alias("label"), F.col("img_emb").alias("vector")).where("label is not null")
        out = out.join(O.encoder_bundle(tag, photos, listings, prompts), "PetID")
    return out.select("PetID", *(F.round(c, 6).alias(c) for c in out.columns if c != "PetID"))


def queries() -> dict[str, Query]:
    named = (
        knn_target_oof, listings, padded_ids, image_index, photo_counts, photoless_share, orphan_photos, text_meta, text_keywords,
        age_and_count, normalized_texts, stratified_folds, class_sample, subsample_means, subsample_kappa, photo_pooling, pet_vectors,
        first_mean_similarity, photo_bags, attention_pooling, attention_by_slot, zero_shot, tfidf_char, tfidf_word, tfidf_word_char, text_components, duplicate_groups,
        duplicate_sweep, kappa, rater_kappa, confusion, roc_auc, spearman, pearson, cut_labels, split_drift, speed_shares, speed_by_age,
        source_by_speed, feature_profile, source_means, length_histogram, speed_spread, largest_group, texts_in_both,
        photo_pets_missing, submission, top_photos, photo_joins, ridge_oof, stacked, blended, column_ablation, penalty_grid, adversarial_auc, principal_components,
        inner_chain, photo_rows, length_boxes, length_density, text_knn_target, encoder_features, level1, ridge_one, boosted_gain, run_gate,
    )
    return {f.__name__: f for f in named}
