"""Text reports and sidecars read as columns: frame reports of a video, and marks drawn on a screenshot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- frame reports ----------------------------------------------------------------------------------------------------


def frame_report(report: Column, files: Column) -> Column:
    """struct(times, error) of a report with one line `frame:N pts:P pts_time:T` for each frame, other lines aside.

    N counts from 0 and T grows; there is one line for each file. The first line that breaks a rule refuses the whole
    report: times is null and error says which rule, and where. A null report has neither lines nor frames."""
    lines = F.filter(F.split(F.coalesce(report, F.lit("")), r"\r?\n"), lambda x: x.startswith("frame:"))

    def read(line: Column, at: Column) -> Column:
        number = F.regexp_extract(line, r"^frame:\+?(\d+)(?=\s|$)", 1)
        stamp = F.regexp_extract(line, r"^\S*(?:\s+(?!pts_time:)\S*)*?\s+pts_time:(\S*)", 1)
        return F.struct(line.alias("line"), at.alias("at"), F.when(number != "", number.try_cast("long")).alias("n"), F.when(stamp != "", stamp.try_cast("double")).alias("t"))

    rows = F.transform(lines, read)

    def fault(row: Column, before: Column) -> Column:
        n, t, at = row["n"], row["t"], row["at"]
        text = lambda c: c.cast("string")
        impossible = F.isnan(t) | (t < 0) | (t == float("inf"))
        return (
            F.when(n.isNull(), F.concat(F.lit("unreadable frame number in "), row["line"]))
            .when(n != at, F.concat(F.lit("frame "), text(n), F.lit(" reported at position "), text(at)))
            .when(t.isNull(), F.concat(F.lit("no readable pts_time in "), row["line"]))
            .when(impossible, F.concat(F.lit("frame "), text(n), F.lit(" has an impossible time")))
            .when(before.isNotNull() & (t <= before["t"]), F.concat(F.lit("frame "), text(n), F.lit(" does not come after frame "), text(n - 1)))
        )

    def judged(rows: Column) -> Column:
        before = F.concat(F.array(F.lit(None)), F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))))
        faults = F.filter(F.zip_with(rows, F.slice(before, F.lit(1), F.size(rows)), fault), lambda x: x.isNotNull())
        count = F.when(F.size(rows) != files, F.concat(files.cast("string"), F.lit(" frame files but "), F.size(rows).cast("string"), F.lit(" timestamps")))
        error = F.coalesce(F.get(faults, 0), count)
        return F.struct(F.when(error.isNull(), F.transform(rows, lambda r: r["t"])).alias("times"), error.alias("error"))

    return F.get(F.transform(F.array(rows), judged), 0)  # rows are read once


# -- marks on a screenshot --------------------------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _string(v: Column, path: str, default: str) -> Column:
    inner = _get(v, path, "variant")
    return F.when(_kind(inner) == "STRING", _get(v, path, "string")).otherwise(F.lit(default))


def _array(v: Column, path: str) -> Column:
    """The elements of an array; null for anything else."""
    return F.when(_kind(_get(v, path, "variant")).startswith("ARRAY"), _get(v, path, "array<variant>"))


def _numbers(elements: Column) -> Column:
    """The numbers among an array's elements."""
    isn = lambda x: _kind(x).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    return F.coalesce(F.transform(F.filter(elements, isn), lambda x: _get(x, "$", "double")), F.array().cast("array<double>"))


def _three(x: Column) -> Column:
    """Three decimals; halves, which are odd sixteenths, go to the even digit."""
    half = F.pmod(x * 16, F.lit(2.0)) == 1
    return F.when(half, F.bround(x.cast("decimal(20,6)"), 3).cast("decimal(20,3)").cast("string")).otherwise(F.format_string("%.3f", x))


def _px(x: Column, size: Column) -> Column:
    return F.round(x * size).cast("long").cast("string")


def described_marks(sidecar: Column) -> Column:
    """What is drawn on a screenshot, as text for a prompt: arrows, boxes, pen strokes and other marks of `annotations`, or
    the named boxes of an older sidecar's `targets`. Empty if there is nothing, or the sidecar isn't JSON.

    Points are parts of the screenshot; with its size they are given in pixels."""

    def described(v: Column) -> Column:
        size = _array(v, "$.size")
        first, second = _numbers(F.slice(size, 1, 1)), _numbers(F.slice(size, 2, 1))
        both = (F.size(first) == 1) & (F.size(second) == 1)
        sw, sh = (F.coalesce(F.when(both, F.get(c, 0)), F.lit(0.0)) for c in (first, second))
        sized = (sw > 0) & (sh > 0)

        def point(p: Column) -> Column:
            x, y = F.get(p, 0), F.get(p, 1)
            text = F.when(sized, F.concat(F.lit("("), _px(x, sw), F.lit(", "), _px(y, sh), F.lit(")"))).otherwise(F.concat(F.lit("("), _three(x), F.lit(", "), _three(y), F.lit(")")))
            return F.when(F.size(p) < 2, F.lit("(?)")).otherwise(text)

        def rect(r: Column) -> list[Column]:
            return [_px(F.get(r, i), s) for i, s in enumerate((sw, sh, sw, sh))]

        def mark(a: Column) -> Column:
            kind, start = _string(a, "$.type", "mark"), F.concat(F.lit("- "), _string(a, "$.color", "red"), F.lit(" "))
            ends = [_numbers(_array(a, f"$.{c}")) for c in ("from", "to")]
            arrow = F.concat(F.lit("ARROW from "), point(ends[0]), F.lit(" to "), point(ends[1]), F.lit(" — points toward / indicates moving something to the arrow's head.\n"))
            r = _numbers(_array(a, "$.rect"))
            x, y, w, h = rect(r)
            loose = F.concat(F.lit("BOX (normalized ["), F.array_join(F.transform(r, lambda n: n.cast("string")), ", "), F.lit("]).\n"))
            box = F.when((F.size(r) == 4) & sized, F.concat(F.lit("BOX at pixels ("), x, F.lit(", "), y, F.lit(") "), w, F.lit("×"), h, F.lit(" — a marked region.\n"))).otherwise(loose)
            strokes = _array(a, "$.points")
            n = F.coalesce(F.size(strokes), F.lit(0)).cast("string")
            n = F.when(strokes.isNull(), F.lit("0")).otherwise(n)
            least = lambda i: F.array_min(F.flatten(F.transform(strokes, lambda p: _numbers(F.slice(_get(p, "$", "array<variant>"), i, 1)))))
            corner = F.array(least(1), least(2))
            around = F.when(F.get(corner, 0).isNotNull() & F.get(corner, 1).isNotNull(), F.concat(F.lit(" around "), point(corner))).otherwise(F.lit(""))
            pen = F.concat(F.lit("freehand PEN mark ("), n, F.lit(" pts)"), F.coalesce(around, F.lit("")), F.lit(".\n"))
            text = F.when(kind == "arrow", arrow).when(kind == "box", box).when(kind == "pen", pen).otherwise(F.concat(kind, F.lit(" annotation.\n")))
            return F.concat(start, text)

        def target(t: Column) -> Column:
            r = _numbers(_array(t, "$.rect"))
            x, y, w, h = rect(r)
            parts = F.array_join(F.transform(r, _three), ", ")
            pixels = F.when(sized, F.concat(F.lit(" ≈ pixels ("), x, F.lit(", "), y, F.lit(") "), w, F.lit("×"), h)).otherwise(F.lit(""))
            line = F.concat(F.lit('- "'), _string(t, "$.label", "box"), F.lit('": normalized ['), parts, F.lit("]"), pixels, F.lit("\n"))
            return F.when(F.size(r) == 4, line).otherwise(F.lit(""))

        def listed(elements: Column, one, before: str, after: str) -> Column:
            lines = F.array_join(F.transform(elements, one), "")
            return F.when(F.size(elements) > 0, F.concat(F.lit(before), F.size(elements).cast("string"), F.lit(after), lines)).otherwise(F.lit(""))

        marks, targets = _array(v, "$.annotations"), _array(v, "$.targets")
        drawn = listed(marks, mark, "The user drew ", " annotation(s) on this screenshot. Read them as visual direction (where to look, what to change, what to move):\n")
        older = listed(targets, target, "This screenshot has ", " annotation box(es) drawn in red. Focus on these marked regions:\n")
        return F.when(marks.isNotNull(), drawn).when(targets.isNotNull(), older).otherwise(F.lit(""))

    return F.coalesce(F.get(F.transform(F.array(F.try_parse_json(sidecar)), described), 0), F.lit(""))
