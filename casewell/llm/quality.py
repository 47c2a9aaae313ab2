"""Quality classifier by hierarchical empirical Bayes.

Evidence of a document: a logistic model over hashed words, character trigrams and the shape of
the text (``evidence``). Evidence of its place: the mean of the other documents' probabilities per
path of its host, shrunk toward that of its host, which is shrunk toward the global mean; a
document's own score takes no part in the posterior of its place, so it counts once. How
strongly is estimated from the data: the prior strength is the Beta prior's that gives the
observed variance between hosts (between paths) beyond what their sizes explain, so sparse places
keep nearly their parent's posterior. The two are joined on the log-odds scale. The same is
done for toxicity, where there are labels of it.

Texts are read twice, once for the labelled sample and once for the scores; what is shuffled are
scores and the texts of the sample. All statistics cover all documents. The logistic model
alone is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evidence
from .common import arrow_rows, discard, hash_sample, stored, trimmed
from .shingles import chunks

MOST_LABELS = 8_000  # labelled documents, about, that the logistic model is fitted on
BROADCAST_PLACES = 100_000
CLIP = 1e-6
ARROW_ROWS = 1000
TEXT_BYTES = 1 << 17  # of texts whose features are made in one go
TARGETS = ("quality", "toxic")


def _labels(labels: DataFrame) -> DataFrame:
    """One row per labelled id, a 0 or 1 (or null) for each target."""
    own = [F.round(F.avg(t)).cast("double").alias(t) if t in labels.columns else F.max(F.lit(None).cast("double")).alias(t) for t in TARGETS]
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(*own).filter("quality is not null or toxic is not null")


def fit_evidence(texts: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> dict[str, tuple[evidence.Evidence, float]]:
    """Target to its model and the share of ones in the sample; a target without labels of both kinds is
    left out. ``texts`` has ``doc_id, text``. The sample are about ``most_labels`` labelled ids, those
    of the smallest hashes; of several texts of one id the least is taken. One task fits on the sample, and
    the models alone come to the driver."""
    known = stored(_labels(labels), "labels", narrow=True)
    some = hash_sample(known, known.count(), most_labels, "doc_id")
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", *TARGETS).agg(F.min("text").alias("text"))  # a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, at, raw in chunks(batch.column(3), TEXT_BYTES):
                owner, bucket, shape = evidence.features(at, raw)
                cuts = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                buckets = pa.ListArray.from_arrays(cuts, pa.array(bucket.astype(np.int32)))
                flat = pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * shape.shape[1], pa.array(shape.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k)[i:j] for k in range(3)], buckets, flat], ["doc_id", *TARGETS, "buckets", "shape"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", *TARGETS, "text").mapInArrow(trimmed(run), f"doc_id {kind}, quality double, toxic double, buckets array<int>, shape array<double>")
    with arrow_rows(texts.sparkSession, ARROW_ROWS):
        stored_sample = stored(found, "sample", narrow=True)
        fitted = stored_sample.coalesce(1).mapInArrow(trimmed(_fit_sample), "target string, share double, start double, weights binary, slopes binary").collect()  # a row for each target
    out = {}
    for r in fitted:
        weights, slopes = np.frombuffer(bytes(r["weights"]), np.float32), np.frombuffer(bytes(r["slopes"]), np.float64)
        out[r["target"]] = evidence.Evidence(r["start"], weights, slopes), r["share"]
    discard(known, stored_sample)
    return {t: out[t] for t in TARGETS if t in out}


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A model for each target with labels of both kinds, fitted by one task on the bounded sample, whose lists never
    come to the driver. Texts are taken in order of their ids, whatever the partitions."""
    ids, labelled, shapes, lists = [], {t: [] for t in TARGETS}, [], []
    for batch in batches:
        ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
        for t in TARGETS:
            labelled[t].append(batch.column(t).to_numpy(zero_copy_only=False).astype(float))
        found = batch.column("buckets")
        cuts, flat = found.offsets.to_numpy(), found.values.to_numpy()
        lists += [flat[s:e].copy() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        shapes.append(batch.column("shape").flatten().to_numpy().reshape(-1, len(evidence.SHAPE)).copy())
    rows = []
    if ids:
        order = np.argsort(np.concatenate(ids))
        shape = np.concatenate(shapes)[order]
        owner = np.repeat(np.arange(len(order), dtype=np.int32), [len(lists[i]) for i in order])
        bucket = np.concatenate([lists[i] for i in order])
        del lists
        for t, parts in labelled.items():
            y = np.concatenate(parts)[order]
            has = np.isfinite(y)
            if len(set(y[has])) < 2:
                continue
            if has.all():
                m = evidence.fit(owner, bucket, shape, y)
            else:
                place, mine = np.cumsum(has, dtype=np.int32) - np.int32(1), has[owner]
                m = evidence.fit(place[owner[mine]], bucket[mine], shape[has], y[has])
            rows.append((t, float(y[has].mean()), m.start, m.weights.astype(np.float32).tobytes(), m.slopes.astype(np.float64).tobytes()))
    names = ["target", "share", "start", "weights", "slopes"]
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def score(texts: DataFrame, models: dict[str, tuple[evidence.Evidence, float]]) -> DataFrame:
    """``texts`` (``text`` its last column) with ``p_<target>`` for each model in place of the text."""
    shared = texts.sparkSession.sparkContext.broadcast({t: m for t, (m, _) in models.items()})  # BUCKETS numbers each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, text = batch.columns
            for i, j, at, raw in chunks(text, TEXT_BYTES):
                f = evidence.features(at, raw)
                p = [pa.array(1 / (1 + np.exp(-np.clip(m.log_odds(*f), -30, 30)))) for m in shared.value.values()]
                yield pa.RecordBatch.from_arrays([*[c[i:j] for c in others], *p], [*batch.schema.names[:-1], *[f"p_{t}" for t in shared.value]])

    fields = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]], *[f"p_{t} double" for t in models]]
    return texts.mapInArrow(trimmed(run), ", ".join(fields))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, total: str, n: str, parent: Column) -> DataFrame:
    """One row, ``kappa``: prior strength by the method of moments over groups with a mean ``total / n``
    and a parent mean. Variance between groups beyond ``parent (1 - parent) / n`` gives
    ``kappa = mean parent (1 - parent) / variance - 1``; none gives a strong prior."""
    size, mean = F.col(n), F.col(total) / F.col(n)
    spread = F.sum(size * (mean - parent) ** 2) / F.sum(size)
    noise = F.sum(parent * (1 - parent)) / F.sum(size)
    inner = F.sum(size * parent * (1 - parent)) / F.sum(size)
    between = spread - noise
    return groups.agg(F.when(between > 1e-9, F.greatest(F.least(inner / between - 1, F.lit(1e6)), F.lit(1.0))).otherwise(1e6).alias("kappa"))


def place_posteriors(scored: DataFrame, p: str, prior: float) -> DataFrame:
    """``scored`` (``host, path`` and the probability ``p`` of each row) with ``p_host, p_path``, the
    posteriors of its place by the other rows, and ``p_both``, which joins them with ``p``.

    With a host's sum S of N probabilities, a path's s of n, the global mean m and prior strengths
    k and l: ``p_host = (S - p + k m) / (N - 1 + k)``, ``p_path = (s - p + l p_host) / (n - 1 + l)``,
    ``logit p_both = logit p + logit p_path - logit prior``. Null hosts are one host, null paths one
    path of each host. ``scored`` is read several times: a stored table."""
    paths = stored(scored.groupBy("host", "path").agg(F.sum(p).alias("s"), F.count(F.lit(1)).alias("n")), "paths", narrow=True)
    hosts = stored(paths.groupBy("host").agg(F.sum("s").alias("host_s"), F.sum("n").alias("host_n")), "hosts", narrow=True)
    whole = hosts.agg((F.sum("host_s") / F.sum("host_n")).alias("mean")).first()["mean"]
    mean = 0.5 if whole is None else whole
    k_host = 1.0 if whole is None else _strength(hosts, "host_s", "host_n", F.lit(mean)).first()["kappa"]
    shrunk = hosts.withColumn("host_p", (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)).withColumnRenamed("host", "__h")
    places = paths.join(shrunk, F.col("host").eqNullSafe(F.col("__h"))).drop("__h")
    k_path = 1.0 if whole is None else _strength(places, "s", "n", F.col("host_p")).first()["kappa"]
    places = stored(places.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "s", "n", "host_s", "host_n"), "places")
    few = F.broadcast(places) if places.count() <= BROADCAST_PLACES else places
    out = scored.join(few, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")))
    out = out.withColumn("p_host", (F.col("host_s") - F.col(p) + k_host * mean) / (F.col("host_n") - 1 + k_host))
    out = out.withColumn("p_path", (F.col("s") - F.col(p) + k_path * F.col("p_host")) / (F.col("n") - 1 + k_path))
    odds = _logit(F.col(p)) + _logit(F.col("p_path")) - _logit(F.lit(prior))
    return out.withColumn("p_both", 1 / (1 + F.exp(-odds))).drop("__h", "__p", "s", "n", "host_s", "host_n")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    most_labels: int = MOST_LABELS,
    least: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, host, path, p_document, p_host, p_path,
    p_quality, kept, p_toxic, toxic``; ``kept`` says ``p_quality >= least``, ``toxic`` ``p_toxic >= least``.

    ``labels`` has ``doc_id, quality`` and may have ``toxic`` (0 or 1; several labels of a document are
    averaged and rounded up, null labels and labels without an id ignored). The sample are about
    ``most_labels`` labelled ids, those of the smallest hashes. Without labels of both kinds every
    document has the probability one of quality and zero of toxicity. Null texts are empty
    texts, very long ones are read whole; null ids are rows like others; null hosts form one host,
    null paths one path of a host; ties do not matter; repeated rows count as rows; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    models = fit_evidence(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")), labels, most_labels)
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), text.alias("text")
    )
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        scored = stored(score(texts, models), "scored")
    names = ["doc_id", "text_hash", "host", "path"]
    out = scored if "quality" in models else scored.withColumn("p_quality", F.lit(1.0))
    prior = {t: models[t][1] if t in models else 1 - CLIP if t == "quality" else CLIP for t in TARGETS}
    if "toxic" in models:
        out = place_posteriors(out, "p_toxic", prior["toxic"]).withColumn("p_toxic", F.col("p_both")).drop("p_host", "p_path", "p_both")
    else:
        out = out.withColumn("p_toxic", F.lit(0.0))
    out = place_posteriors(out, "p_quality", prior["quality"])
    six = lambda c: F.round(c, 6)
    return out.select(
        *names,
        six("p_quality").alias("p_document"),
        six("p_host").alias("p_host"),
        six("p_path").alias("p_path"),
        six("p_both").alias("p_quality"),
        (six("p_both") >= least).alias("kept"),
        six("p_toxic").alias("p_toxic"),
        (six("p_toxic") >= least).alias("toxic"),
    )
