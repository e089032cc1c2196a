"""Threshold ladders: a score or a flag to pass, manual or fail, as column expressions.

Statuses are ``pass``, ``manual``, ``fail`` and ``error``. Every function takes columns and gives a column; a null or
NaN score never passes for a high one (Spark puts NaN above all numbers).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x``, or null where it is NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def unit_score(x: Column) -> Column:
    """A model score that must lie in 0..1, else null."""
    return F.when(finite(x).between(0, 1), x)


def suspicious_unit(x: Column) -> Column:
    """Whether a 0..1 score lies so near an end that it is kept with a warning."""
    return F.coalesce((unit_score(x) < 0.1) | (unit_score(x) > 0.9), F.lit(False))


def text_tier(confidence: Column, n: Column) -> Column:
    """Overlaid text: confidence in percent and number of texts."""
    return F.when((confidence > 80) | (n > 5), "fail").when((confidence > 60) | (n > 2), "manual").otherwise("pass")


def text_pass(confidence: Column, n: Column) -> Column:
    """The two-way rule of the unified run."""
    return ~((confidence > 60) | (n > 2))


def watermark_tier(has: Column, percent: Column) -> Column:
    """Standalone: on the percentage of the watermarked class; an unknown flag is an error."""
    return F.when(has.isNull(), "error").when(has & (percent > 96), "fail").when(has & (percent > 91), "manual").otherwise("pass")


def watermark_summary_tier(has: Column, percent: Column) -> Column:
    """As the printed summary counts: thresholds are inclusive, errors count as failures."""
    return F.when(has.isNull(), "fail").when(has & (percent >= 96), "fail").when(has & (percent >= 91), "manual").otherwise("pass")


def watermark_compat_tier(predicted_percent: Column) -> Column:
    """As the older pipeline: on the percentage of whichever class was predicted."""
    return F.when(predicted_percent > 96, "fail").when(predicted_percent > 91, "manual").otherwise("pass")


def watermark_flagged(has: Column, percent: Column, threshold: float = 95.0) -> Column:
    return F.coalesce(has & (percent > threshold), F.lit(False))


def editing_tier(score: Column, invalid: float = 30.0, manual: float = 25.0) -> Column:
    """Standalone: above ``invalid`` fails, ``manual`` and above is for review."""
    score = finite(score)
    return F.when(score.isNull(), "error").when(score > invalid, "fail").when(score >= manual, "manual").otherwise("pass")


def editing_pipeline_tier(score: Column) -> Column:
    """In the pipeline: inclusive at 25 and 20; a detector that could not run passes."""
    score = finite(score)
    return F.when(score.isNull(), "pass").when(score >= 25, "fail").when(score >= 20, "manual").otherwise("pass")


def editing_table_tier(score: Column) -> Column:
    score = finite(score)
    return F.when(score.isNull(), "error").when(score >= 30, "fail").when(score >= 25, "manual").otherwise("pass")


def editing_display(score: Column) -> Column:
    score = finite(score)
    return F.when(score > 30, "Invalid - heavily edited").when(score >= 25, "Manual review needed").when(score >= 18, "Possible light editing").otherwise("Minimal/natural editing")


def editing_category(score: Column) -> Column:
    return F.when(score >= 75, "Heavy Editing Detected").when(score >= 60, "Moderate Editing Detected").when(score >= 40, "Light Editing Detected").otherwise("Natural/Minimal Editing")


def border_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.58, "fail").when(confidence >= 0.35, "manual").otherwise("pass")


def border_flag_verdict(simple: Column, frame: Column, textured: Column) -> Column:
    """In the pipeline: any of three shapes fails, whatever the confidence."""
    return F.when(simple | frame | textured, "fail").otherwise("pass")


def border_settled_flag(flag: Column, confidence: Column) -> Column:
    """A shape flag (unknown counts as set), withdrawn where confidence is 0.15 or less."""
    return F.when(confidence <= 0.15, F.lit(False)).otherwise(F.coalesce(flag, F.lit(True)))


def border_settled_reason(reason: Column, confidence: Column) -> Column:
    """The reason that goes with ``border_settled_flag``: weak findings are none."""
    return F.when(confidence <= 0.15, "no border (confidence of 0.15 or less)").otherwise(reason)


def border_label(manual: Column, simple: Column, textured: Column, frame: Column) -> Column:
    return F.when(manual, "Manual Review").when(simple, "Simple Border").when(textured, "Textured Frame").when(frame, "Frame Structure").otherwise("No Border")


def adapted_threshold(width: Column, height: Column, base: Column | float = 30.0) -> Column:
    """The colour threshold of border checks, by resolution against full HD."""
    scale, base = F.sqrt(width * height / F.lit(1920.0 * 1080.0)), F.lit(base) if isinstance(base, float) else base
    return F.when(scale < 0.5, F.greatest(F.lit(15.0), base * 0.7)).when(scale > 2, F.least(F.lit(50.0), base * 1.2)).otherwise(base)


def statistic_thresholds(mean: Column, deviation: Column, texture: Column, shorter: Column, base: float = 30.0, sensitivity: float = 1.8, perimeter: float = 0.15) -> Column:
    """Settings adapted to a picture's statistics: struct<low, high, contrast, sensitivity, perimeter>.

    ``low`` and ``high`` are edge thresholds, by brightness where contrast is low or high; ``texture`` is the mean of
    the Laplacian, ``shorter`` the shorter side.
    """
    low = F.when(deviation < 30, F.greatest(F.lit(10), F.floor(mean * 0.3))).when(deviation > 60, F.greatest(F.lit(30), F.floor(mean * 0.4))).otherwise(F.lit(50))
    high = F.when(deviation < 30, F.greatest(F.lit(30), F.floor(mean * 0.8))).when(deviation > 60, F.greatest(F.lit(90), F.floor(mean))).otherwise(F.lit(150))
    contrast = F.when(deviation < 20, F.greatest(F.lit(15.0), F.lit(base * 0.7))).when(deviation > 50, F.least(F.lit(50.0), F.lit(base * 1.3))).otherwise(F.lit(base))
    rough = F.when(texture < 3, F.greatest(F.lit(1.5), F.lit(sensitivity * 0.8))).when(texture > 10, F.least(F.lit(3.0), F.lit(sensitivity * 1.2))).otherwise(F.lit(sensitivity))
    rim = F.when(shorter < 500, F.least(F.lit(0.25), F.lit(perimeter * 1.2))).when(shorter > 2000, F.greatest(F.lit(0.1), F.lit(perimeter * 0.8))).otherwise(F.lit(perimeter))
    return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), contrast.alias("contrast"), rough.alias("sensitivity"), rim.alias("perimeter"))


#: First match wins. Fixed values.
ERROR_KINDS = [
    ("unknown exception", "paddle_unknown_exception"),
    ("orientation", "paddle_orientation_issue"),
    ("textline", "paddle_orientation_issue"),
    ("memory", "paddle_resource_issue"),
    ("cuda", "paddle_resource_issue"),
    ("gpu", "paddle_resource_issue"),
    ("could not load", "image_load_error"),
]


def error_kind(message: Column) -> Column:
    """A category for an error message by the first known word in it."""
    low, out = F.lower(message), F.lit("general_error")
    for word, kind in reversed(ERROR_KINDS):
        out = F.when(low.contains(word), kind).otherwise(out)
    return F.when(message.isNull(), None).otherwise(out)


def cut_name(name: Column, most: int, kept: int, dots: str = "...") -> Column:
    """A name for display: of more than ``most`` characters, the first ``kept`` and dots."""
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, kept), F.lit(dots))).otherwise(name)


def border_reason(found: Column, primary: Column, vignette: Column, artifacts: Column, uniform: Column) -> Column:
    """Why a border was or wasn't found, by the method with most evidence (null: several)."""
    without = F.when(vignette > 0.5, "vignette without border").when(artifacts, "compression artifacts without border").when(uniform, "uniform background without border").otherwise("no border or frame")
    within = F.when(primary == "obvious", "obvious border").when((primary == "simple") & uniform, "simple uniform border").when(primary == "simple", "simple border by color or texture").when(primary == "frame", "frame by contours").when(primary == "texture", "textured border").otherwise("border by several methods")
    return F.when(found, within).otherwise(without)


def _level(x: Column, above: list[tuple[float, str]], below: tuple[float, str] | None = None) -> Column:
    out = F.when(x < below[0], below[1]) if below else F.lit(None).cast("string")
    for cut, name in reversed(above):
        out = F.when(x > cut, name).otherwise(out)
    return out


def interpretation(brisque: Column, niqe: Column, clipiqa: Column, clipping: Column, entropy: Column, laplacian: Column, density: Column, high_freq: Column) -> Column:
    """The findings that apply, in order; an empty array where nothing stands out. Unknown scores find nothing."""
    return F.array_compact(
        F.array(
            _level(finite(brisque), [(65, "brisque: significant degradation"), (45, "brisque: moderate issues")], (25, "brisque: excellent")),
            _level(finite(niqe), [(10, "niqe: poor naturalness"), (6, "niqe: reduced naturalness")], (4, "niqe: excellent")),
            _level(finite(clipiqa), [(0.7, "clipiqa: high quality")], (0.4, "clipiqa: poor quality")),
            _level(clipping, [(2, "clipping: tone mapping or exposure")]),
            _level(entropy, [(7.9, "entropy: artificial enhancement")], (6.0, "entropy: tone manipulation")),
            _level(laplacian, [(3000, "laplacian: artificial sharpening")], (50, "laplacian: over-smoothing")),
            _level(density, [(0.2, "edges: over-enhancement")], (0.03, "edges: blur or smoothing")),
            _level(high_freq, [(0.25, "frequencies: artificial enhancement")], (0.02, "frequencies: over-smoothing")),
        )
    )


#: By kind of detector, first match wins: words that must all be in the message, and the kind. Fixed values.
DETECTOR_ERRORS = {
    "watermark": [(("unidentified image",), "unsupported_format"), (("cannot identify image",), "unsupported_format"), (("cuda", "memory"), "gpu_memory"), (("dll",), "library")],
    "model_load": [(("weights_only",), "incompatible_weights"), (("restore data location",), "corrupt_weights")],
    "runtime": [(("dll",), "library"), (("cuda",), "no_gpu")],
}


def detector_error(message: Column, detector: str) -> Column:
    """The kind of a detector's error, ``other`` for what is not listed, null for none."""
    low, out = F.lower(message), F.lit("other")
    for words, kind in reversed(DETECTOR_ERRORS[detector]):
        held = F.lit(True)
        for w in words:
            held = held & low.contains(w)
        out = F.when(held, kind).otherwise(out)
    return F.when(message.isNull(), None).otherwise(out)


#: Words of a console line and what it shows, first match wins. Fixed values.
CONSOLE_LINES = [("Processing image", "step"), ("Analyzing", "step"), ("Score:", "result"), ("Quality:", "result"), ("Invalid:", "failure"), ("Failed:", "failure"), ("Completed", "done"), ("Finished", "done")]
#: Log messages with one of these are not shown. Fixed values.
BLOCKED_LOG = ["Could not find files for the given pattern", "INFO: Could not find files", "No ccache found"]


def console_kind(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, kind in reversed(CONSOLE_LINES):
        out = F.when(line.contains(word), kind).otherwise(out)
    return out


def shown_in_log(message: Column) -> Column:
    out = F.lit(True)
    for word in BLOCKED_LOG:
        out = out & ~F.coalesce(message.contains(word), F.lit(False))
    return out


def title_case(name: Column) -> Column:
    """``some_test`` as ``Some Test``."""
    return F.initcap(F.translate(name, "_", " "))


def softmax(logits: Column) -> Column:
    """Shares of an array of logits; null for an empty one."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(logits) > 0, F.transform(e, lambda x: x / total))


def argmax(values: Column) -> Column:
    """The place of the largest value, from 0; the first among equals."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def findings(brisque: Column, niqe: Column, clipiqa: Column, clipping: Column, entropy: Column, laplacian: Column, density: Column, high_freq: Column, n_models: Column, overall: Column, category: Column, confidence: Column) -> Column:
    """``interpretation`` as array<struct<code, value>> with the figure behind each finding; the overall one is last and always there."""
    marks = interpretation(brisque, niqe, clipiqa, clipping, entropy, laplacian, density, high_freq)
    figures = {"brisque": brisque, "niqe": niqe, "clipiqa": clipiqa, "clipping": clipping, "entropy": entropy, "laplacian": laplacian, "edges": density, "frequencies": high_freq}

    def valued(mark: Column) -> Column:
        value = F.lit(None).cast("double")
        for name, column in figures.items():
            value = F.when(mark.startswith(f"{name}:"), column).otherwise(value)
        return F.struct(mark.alias("code"), value.alias("value"))

    reliability = F.when(n_models >= 2, "high reliability").when(n_models == 1, "moderate reliability").otherwise("features only")
    last = F.struct(F.concat_ws(", ", F.concat(F.lit("overall: "), category), confidence, reliability).alias("code"), overall.cast("double").alias("value"))
    return F.array_append(F.transform(marks, valued), last)


def insights(brisque: Column, niqe: Column, clipiqa: Column, clipping: Column, entropy: Column, density: Column, variance: Column) -> Column:
    """What points to editing, joined by semicolons; a general line where nothing in particular does. Unknown scores point to nothing."""
    listed = [
        (brisque > 50, "brisque: unnatural quality"), (niqe > 8, "niqe: degraded naturalness"), (clipiqa < 0.5, "clipiqa: low perceptual quality"), (clipping > 0.1, "clipping: overexposure or contrast"),
        (entropy < 6, "entropy: tone mapping or grading"), (density > 0.2, "edges: sharpening"), (variance > 25, "frequencies: filtering or enhancement"),
    ]
    found = F.array_join(F.array_compact(F.array(*[F.when(on, text) for on, text in listed])), "; ")
    return F.when(found == "", "general signs of editing").otherwise(found)
