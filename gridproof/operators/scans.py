"""From pictures to verdicts: border and editing findings of a picture, and a registry of tests that share one decoding.

A test is a function of columns (the measures in ``m``, the picture's properties, scores from elsewhere) that gives
struct<status, reason, score>; it names the parts of the measures it needs. All tests of a run are columns of one
projection over one pass of ``pictures.measured``, and come out as long verdicts for ``operators/verdicts.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions import scores as sc
from ..functions import tiers
from ..sources.tables import written
from . import pictures, specs

BORDER_PARTS = ("hist", "rims", "even", "blocks", "shade", "kernels", "frames")
EDITING_PARTS = ("hist", "kernels")
#: A border counts as found above this confidence.
LEAST_CONFIDENCE = 0.35


def with_borders(measured: DataFrame) -> DataFrame:
    """``measured`` (with BORDER_PARTS) with ``b``: struct of every border method's result, the adapted settings, confidence, flag, reason and tier.

    A method is evidence only where it found something. Contrast, texture sensitivity and perimeter are adapted to the
    picture's statistics, then contrast to its resolution. Where a picture is too small for contours there is no frame.
    Each step is a column of its own, so that what is used often is computed once.
    """
    m, w, h, no = pictures.m, F.col("width"), F.col("height"), F.lit(False)
    f = measured.withColumn("_set", tiers.statistic_thresholds(m("mean"), m("deviation"), m("texture"), F.least(w, h)))
    f = f.withColumns({"_contrast": tiers.adapted_threshold(w, h, F.col("_set.contrast")), "_shade": pictures.vignetting()})
    f = f.withColumns({"_obvious": pictures.obvious(), "_simple": pictures.simple(F.col("_contrast"), dark=F.col("_shade")), "_even": pictures.uniform(), "_blocks": pictures.blockiness()})
    found = {
        "obvious": (F.col("_obvious.detected"), F.col("_obvious.confidence")),
        "simple": (F.col("_simple.detected"), F.col("_simple.score")),
        "frame": (m("frame"), m("frame_score")),
        "texture": (m("adapted_texture_ratio") > F.col("_set.sensitivity"), F.least(F.lit(1.0), m("adapted_texture_ratio") / 3)),
    }
    f = f.withColumns(
        {f"_{k}_on": F.coalesce(on, no) for k, (on, _) in found.items()}
        | {f"_{k}_score": score for k, (_, score) in found.items()}
        | {"_vignette": F.when(F.col("_shade.vignetted"), F.col("_shade.score")).otherwise(0.0), "_artifacts": F.coalesce("_blocks.blocky", no), "_uniform": F.coalesce("_even.uniform", no)}
    )
    on, score = {k: F.col(f"_{k}_on") for k in found}, {k: F.col(f"_{k}_score") for k in found}
    evidence = F.array_compact(F.array(*[F.when(on[k], F.struct(F.lit(k).alias("method"), score[k].alias("score"))) for k in found]))
    first = F.array_max(F.array(*[F.when(on[k], F.struct(score[k].alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("m"))) for i, k in enumerate(found)]))["m"]
    f = f.withColumns({"_evidence": evidence, "_first": first, "_any": on["obvious"] | on["simple"] | on["frame"] | on["texture"]})
    f = f.withColumn("_confidence", sc.robust_confidence(F.col("_evidence"), m("noise"), F.col("_uniform"), F.col("_artifacts"), F.col("_vignette")))
    confidence, tier = F.col("_confidence"), tiers.border_tier(F.col("_confidence"))
    settled = {k: tiers.border_settled_flag(on[k], confidence) for k in ("simple", "frame", "texture")}
    reason = tiers.border_reason(F.col("_any"), F.col("_first"), F.col("_vignette"), F.col("_artifacts"), F.col("_uniform"))
    b = F.struct(
        *[on[k].alias(k) for k in found],
        F.col("_contrast").alias("contrast"),
        F.col("_vignette").alias("vignette"),
        F.col("_uniform").alias("uniform"),
        F.col("_artifacts").alias("artifacts"),
        m("noise").alias("noise"),
        confidence.alias("confidence"),
        (F.col("_any") & (confidence > LEAST_CONFIDENCE)).alias("detected"),
        tiers.border_settled_reason(reason, confidence).alias("reason"),
        tier.alias("tier"),
        tiers.border_label(tier == "manual", settled["simple"], settled["texture"], settled["frame"]).alias("label"),
    )
    return f.select(*measured.columns, F.when(F.col("m").isNotNull(), b).alias("b"))


def border_scan(rows: DataFrame, key: str = "image") -> DataFrame:
    """(key and the fields of ``with_borders``) for pictures of any size; undecodable ones have tier ``error``."""
    return with_borders(pictures.measured(rows, *BORDER_PARTS)).select(key, "b.*").withColumn("tier", F.coalesce("tier", F.lit("error")))


def editing_features(measured: DataFrame) -> DataFrame:
    """``measured`` (with parts hist and kernels) with ``e``: struct of norms, feature scores, overall score, confidence and categories.

    Model scores are the columns brisque, niqe and clipiqa; nulls and values that are none count as no model.
    """
    kept = measured.columns
    from .pixels import histogram_scores

    hist = histogram_scores(measured.withColumn("p", pictures.shares()), *kept)
    f = hist.withColumns({"_b": sc.brisque_norm(F.col("brisque")), "_q": sc.niqe_norm(F.col("niqe")), "_c": sc.clipiqa_norm(F.col("clipiqa"))})
    norms = [F.col(c) for c in ("_b", "_q", "_c")]
    f = f.withColumns(
        {
            "_n": sc.model_count(*norms),
            "_quality": sc.model_average(*norms),
            "_hist": sc.histogram_score(F.col("total_clipping"), F.col("entropy"), F.col("ks")),
            "_edge": sc.edge_score(F.col("m.laplacian_variance"), F.col("m.edge_density"), F.col("m.high_freq_energy")),
            "_freq": sc.frequency_score(F.col("m.high_freq"), F.col("m.frequency_variance")),
        }
    )
    f = f.withColumn("_overall", sc.overall_score(*[F.col(c) for c in ("_n", "_quality", "_hist", "_edge", "_freq")]))
    found = F.struct(
        F.col("_n").alias("n_models"),
        F.col("_quality").alias("quality"),
        F.col("_hist").alias("histogram"),
        F.col("_edge").alias("edges"),
        F.col("_freq").alias("frequencies"),
        F.col("_overall").alias("overall"),
        sc.confidence_label(*[F.col(c) for c in ("_n", "_hist", "_edge", "_freq", "_overall")]).alias("confidence"),
        tiers.editing_category(F.col("_overall")).alias("category"),
        tiers.editing_tier(F.col("_overall")).alias("tier"),
        tiers.interpretation(*[F.col(c) for c in ("brisque", "niqe", "clipiqa", "total_clipping", "entropy", "m.laplacian_variance", "m.edge_density", "m.high_freq")]).alias("findings"),
    )
    return f.select(*kept, F.when(F.col("m").isNotNull(), found).alias("e"))


def editing_scan(scored: DataFrame, key: str = "image") -> DataFrame:
    """(key, n_models, quality, histogram, edges, frequencies, overall, confidence, category, tier, findings); undecodable pictures have tier ``error``."""
    e = editing_features(pictures.measured(scored, *EDITING_PARTS))
    return e.select(key, "e.*").withColumn("tier", F.coalesce("tier", F.lit("error"))).withColumn("findings", F.array_join("findings", "; "))


@dataclass
class Test:
    """A test of the registry: the parts of the measures and the columns it needs, its verdict, and what stands in where it cannot run."""

    verdict: Callable[[], Column]
    parts: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    fallback: Callable[[], Column] | None = None
    fallback_parts: tuple[str, ...] = ()


def verdict(status: Column, reason: Column, score: Column | float = 0.0) -> Column:
    return F.struct(status.alias("status"), reason.alias("reason"), (F.lit(score) if isinstance(score, float) else score).cast("double").alias("score"))


def _status(passed: Column) -> Column:
    return F.when(passed.isNull(), "error").when(passed, "pass").otherwise("fail")


def _specification() -> Column:
    spec = specs.best_spec({c: F.col(c) for c in specs.PROPERTIES})
    return verdict(_status(spec.isNotNull()), F.coalesce(F.concat(F.lit("matches "), spec), F.lit("no specification matches")))


def _plain_size() -> Column:
    got = specs.fallback_spec(F.col("width"), F.col("height"))
    return verdict(_status(got == "ok"), got)


def _borders() -> Column:
    return verdict(F.col("b.tier"), F.col("b.reason"), F.col("b.confidence"))


def _plain_borders() -> Column:
    e = pictures.edge_strips()
    return verdict(_status(~e["bordered"]), F.when(e["bordered"], "even strips along the edges").otherwise("no even strips"), e["variance"])


def _watermarks() -> Column:
    has, percent = F.col("has_watermark"), F.col("watermark_percent")
    return verdict(tiers.watermark_tier(has, percent), F.when(has.isNull(), "no result").when(has, "watermark").otherwise("no watermark"), percent)


def _text() -> Column:
    c, n = F.col("text_confidence"), F.col("n_texts")
    return verdict(tiers.text_tier(c, n), F.concat(n.cast("string"), F.lit(" texts")), c)


def _editing() -> Column:
    return verdict(F.col("e.tier"), F.concat_ws(", ", "e.category", "e.confidence"), F.col("e.overall"))


def _plain_editing() -> Column:
    e = pictures.fallback_editing()
    return verdict(_status(e["passed"]), F.when(e["passed"], "histograms are natural").otherwise("few tones or many peaks"), e["score"])


def _unknown() -> Column:
    return verdict(F.lit("pass"), F.lit("not available"))


#: The tests in their fixed order.
REGISTRY: dict[str, Test] = {
    "specifications": Test(_specification, columns=specs.PROPERTIES, fallback=_plain_size),
    "borders": Test(_borders, BORDER_PARTS, fallback=_plain_borders, fallback_parts=("edge",)),
    "watermarks": Test(_watermarks, columns=("has_watermark", "watermark_percent"), fallback=_unknown),
    "editing": Test(_editing, EDITING_PARTS, ("brisque", "niqe", "clipiqa"), _plain_editing, ("levels",)),
    "text": Test(_text, columns=("text_confidence", "n_texts"), fallback=_unknown),
}


def selected(names: list[str] | None = None, without: list[str] | None = None) -> list[str]:
    """The tests to run, in the registry's order: all, or those named, less some; an unknown name is an error."""
    asked = [*(names if names is not None else REGISTRY), *(without or [])]
    if unknown := [n for n in asked if n not in REGISTRY]:
        raise ValueError(f"unknown tests: {', '.join(unknown)}")
    return [n for n in REGISTRY if (names is None or n in names) and n not in (without or [])]


def available(columns: list[str]) -> dict[str, str]:
    """For each test whether it runs over these columns as ``full`` or ``fallback``, or ``missing``."""
    return {n: "full" if set(t.columns) <= set(columns) else "fallback" if t.fallback else "missing" for n, t in REGISTRY.items()}


def unified(scored: DataFrame, tests: list[str] | None = None, key: str = "image", plain: tuple[str, ...] = ()) -> DataFrame:
    """(key, filename, test, test_ord, status, reason, score): a row for each picture and test, from one pass over the pictures.

    A test whose columns are not there, or that is named in ``plain``, is replaced by its fallback. A picture that can't be decoded has status
    ``error`` in every test that looks at its pixels.
    """
    names, states = selected(tests), available(scored.columns)
    full = {n: states[n] == "full" and n not in plain for n in names}
    if lost := [n for n in names if not full[n] and REGISTRY[n].fallback is None]:
        raise ValueError(f"tests that can't run here: {', '.join(lost)}")
    parts = {p for n in names for p in (REGISTRY[n].parts if full[n] else REGISTRY[n].fallback_parts)}
    m = pictures.measured(scored, *[p for p in pictures.PARTS if p in parts]) if parts else scored
    if full.get("editing"):
        m = editing_features(m)
    if full.get("borders"):
        m = with_borders(m)
    rows = []
    for n in names:
        test = REGISTRY[n]
        got, looks = (test.verdict(), test.parts) if full[n] else (test.fallback(), test.fallback_parts)
        if looks:
            got = F.when(F.col("m").isNull(), verdict(F.lit("error"), F.lit("not decoded"))).otherwise(got)
        rows.append(F.struct(F.lit(n).alias("test"), F.lit(list(REGISTRY).index(n) + 1).alias("test_ord"), got.alias("v")))
    name = F.col("filename") if "filename" in scored.columns else F.col(key).cast("string")
    long = m.select(F.col(key), name.alias("filename"), F.explode(F.array(*rows)).alias("t"))
    return long.select(key, "filename", "t.test", "t.test_ord", "t.v.status", "t.v.reason", "t.v.score")


#: Words of errors that may pass when a model is asked again. Fixed values.
PASSING_ERRORS = ("memory", "cuda", "dll")


def answered(models: list[Callable[[list], list]], values: list[list], attempts: int, spare: object) -> list:
    """What the first model gives that doesn't raise, each asked again after a passing error; else row by row, ``spare`` for what none can do."""
    for model in models:
        for _ in range(attempts):
            try:
                return list(model(*values))
            except Exception as e:
                if not any(w in str(e).lower() for w in PASSING_ERRORS):
                    break
    if len(values[0]) == 1:
        return [spare]
    return [answered(models, [[v] for v in one], attempts, spare)[0] for one in zip(*values)]


#: Pixels that a model is given at a time, where its rows say how large they are.
MOST_PIXELS = 1 << 24


def by_weight(weights: list, most: int) -> list[list[int]]:
    """The rows in batches of ``most`` weight at most, or one row, like sizes together; a null weight is none."""
    order = sorted(range(len(weights)), key=lambda i: (weights[i] or 0, i))
    out: list[list[int]] = []
    total = 0
    for i in order:
        w = weights[i] or 0
        if not out or total + w > most:
            out.append([])
            total = 0
        out[-1].append(i)
        total += w
    return out


def asked_in_batches(models: list[Callable[[list], list]], values: list[list], weights: list | None, most: int, attempts: int, spare: object) -> list:
    """``answered`` in batches by weight, the answers in the order of the rows."""
    if not values[0]:
        return []
    out: list = [None] * len(values[0])
    for rows in by_weight(weights, most) if weights is not None else [list(range(len(values[0])))]:
        for i, got in zip(rows, answered(models, [[v[i] for i in rows] for v in values], attempts, spare)):
            out[i] = got
    return out


def with_scorer(rows: DataFrame, name: str, load: Callable[[], Callable | list[Callable]], *columns: str, spare: object = None, kind: str = "double", attempts: int = 3, weight: Column | None = None, most: int = MOST_PIXELS) -> DataFrame:
    """``rows`` with a column ``name`` of ``kind`` by a model that each task loads once: ``load()`` gives a function of lists of values.

    ``load()`` may give several functions, say one for each colour order: the next is asked where one raises. Errors of
    memory or libraries are tried again, ``attempts`` times in all. Where a batch fails its rows are asked one by one, and
    those that still fail get ``spare``. With ``weight`` (say, width times height) a model gets rows of like size
    together, of ``most`` weight in all. The column is not deterministic to the planner, so a filter on what is derived
    from it does not ask again; plans that branch after it do, for which there is ``scored_once``.
    """
    out = to_arrow_schema(StructType.fromDDL(f"x {kind}")).field("x").type
    heavy = weight is not None

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        got = load()
        models = got if isinstance(got, list) else [got]
        for batch in batches:
            values = [c.to_pylist() for c in batch]
            yield pa.array(asked_in_batches(models, values[: len(columns)], values[-1] if heavy else None, most, attempts, spare), out)

    def single(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run((b,) for b in batches)

    given = [*columns, weight] if heavy else columns
    return rows.withColumn(name, F.arrow_udf(run if len(given) > 1 else single, kind).asNondeterministic()(*given))


def scored_once(rows: DataFrame, name: str, load: Callable[[], Callable | list[Callable]], *columns: str, key: str = "image", profile: ResourceProfile | None = None, spare: object = None, kind: str = "double", attempts: int = 3, weight: Column | None = None, most: int = MOST_PIXELS) -> DataFrame:
    """(key, name): a model's answers as a written table, which may be joined and filtered at will without asking again.

    ``profile`` asks the cluster for executors fit for the model (memory, GPUs) in this stage alone. Other parameters are
    those of ``with_scorer``. Lost executors cost the answers of their open tasks only.
    """
    out = to_arrow_schema(StructType.fromDDL(f"x {kind}")).field("x").type
    schema = StructType([StructField("key", rows.schema[key].dataType), StructField(name, StructType.fromDDL(f"x {kind}")["x"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = load()
        models = got if isinstance(got, list) else [got]
        for batch in batches:
            values = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            found = asked_in_batches(models, values[: len(columns)], values[-1] if weight is not None else None, most, attempts, spare)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, out)], ["key", name])

    given = [F.col(c).alias(f"v{i}") for i, c in enumerate(columns)] + ([weight.alias("weight")] if weight is not None else [])
    return written(rows.select(F.col(key).alias("key"), *given).mapInArrow(run, schema, profile=profile), "answers").withColumnRenamed("key", key)


def watermark_batch(rows: DataFrame, load: Callable[[], Callable | list[Callable]], *columns: str) -> DataFrame:
    """``rows`` with has_watermark, watermark_percent and watermark_status by a model that gives two logits (clean, marked) for each row; null: error."""
    scored = with_scorer(rows, "_logits", load, *columns, kind="array<double>")
    share = tiers.softmax(F.col("_logits"))
    found = scored.withColumns({"has_watermark": tiers.argmax(F.col("_logits")) == 1, "watermark_percent": F.get(share, 1) * 100}).drop("_logits")
    return found.withColumn("watermark_status", tiers.watermark_tier(F.col("has_watermark"), F.col("watermark_percent")))


TEXT = "array<struct<text: string, confidence: double, detection: double, recognition: double, w: int, h: int>>"


def text_batch(rows: DataFrame, load: Callable[[], Callable | list[Callable]], *columns: str, key: str = "image") -> DataFrame:
    """(key, n_texts, overall_confidence, status, unified_pass) by a recogniser that gives the texts of each picture; one that fails is an error."""
    from . import ocr

    found = with_scorer(rows, "_texts", load, *columns, kind=TEXT).select(key, F.col("_texts").isNull().alias("_failed"), F.explode_outer("_texts").alias("t")).select(key, "_failed", "t.*")
    kept = ocr.keep_text(F.col("text"), F.col("confidence"), F.col("w"), F.col("h"))
    m = ocr.confidence_metrics(found, kept, key, F.max("_failed").alias("_failed"))  # one grouping: the model is asked once
    tier = tiers.text_tier(F.col("overall_confidence"), F.col("n_texts"))
    return m.select(key, "n_texts", "overall_confidence", F.when(F.col("_failed"), "error").otherwise(tier).alias("status"), tiers.text_pass(F.col("overall_confidence"), F.col("n_texts")).alias("unified_pass"))


def models_to_use(known: list[str], wanted: list[str] | None = None, excluded: list[str] | None = None, last: str = "clipiqa") -> list[str]:
    """The models to load: those wanted that are known, in their order; else all known but the excluded, and ``last`` at the end unless excluded."""
    if wanted:
        return [m for m in wanted if m in known or m == last]
    return [m for m in [*[k for k in known if k != last], last] if m not in (excluded or [])]
