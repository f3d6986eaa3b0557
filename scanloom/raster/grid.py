"""Page images as scanlines: one row per image row, one array per channel.

Columns: ``page_id``, ``band``, ``y``, ``h``, ``w``, ``core`` and one ``array<int>`` per plane. A page
is cut into bands of image rows, each with a margin of neighbouring rows (``core`` is false there).
Everything that looks at neighbours works inside (page, band), so one shuffle by that key serves a
whole filter, and a huge page is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scanloom.llm.common import ship

BAND_ROWS = 2048
MARGIN_ROWS = 160
KEY = ["page_id", "band"]
POSITION = ["page_id", "band", "y", "h", "w", "core"]


def to_bands(lines: DataFrame, band_rows: int = BAND_ROWS, margin: int = MARGIN_ROWS) -> DataFrame:
    """Cut pages ``(page_id, y, h, w, planes…)`` into bands with margins."""
    y, last = F.col("y"), F.floor((F.col("h") - 1) / band_rows)
    first = F.greatest(F.lit(0), F.floor((y - margin) / band_rows))
    bands = F.sequence(first.cast("int"), F.least(last, F.floor((y + margin) / band_rows)).cast("int"))
    planes = [c for c in lines.columns if c not in POSITION]
    return lines.withColumn("band", F.explode(bands)).select(
        "page_id", "band", "y", "h", "w",
        (F.floor(y / band_rows) == F.col("band")).alias("core"),
        *planes,
    )


def whole(px: DataFrame) -> bool:
    """Whether the pages are known to have one band each; see ``by_size``."""
    return bool(getattr(px, "_whole", None))


def by_size(px: DataFrame, fn: Callable[[DataFrame], DataFrame], pages_only: bool = True) -> DataFrame:
    """``fn`` on the pages of one band and, apart from them, on those of several.

    A page of one band lies in one group of scanlines, so a neighbourhood step sees all of it and takes its
    page statistics too (``whole``): its scanlines need no shuffle but the one by band, and none at all where
    Spark has them dealt by page already. Statistics of larger pages travel between their bands, as ``settle``
    says. Rows without page are dropped, or with ``pages_only`` off go with those.
    """
    if getattr(px, "_whole", None) is not None:
        return fn(px)
    one, known = F.coalesce(F.col("h") <= BAND_ROWS, F.lit(False)), F.col("page_id").isNotNull()
    parts = []
    for kept, condition in ((True, one & known), (False, ~one & known if pages_only else ~(one & known))):
        # The steps so far stay open for further ones.
        base, steps = getattr(px, "_chain", (px, []))
        own = base.filter(condition)
        own._whole = kept
        parts.append(fn(chained(own, steps, px.columns) if steps else own))
    return _apart(parts)


def _apart(parts: list[DataFrame]) -> DataFrame:
    """The parts together; what reads only some of their columns, or their text, does so in each."""
    joined = parts[0].unionByName(parts[1])
    joined._parts = parts
    return joined


def core(px: DataFrame) -> DataFrame:
    """Every image row once, without margins."""
    return px.filter("core").drop("band", "core")


def rows_in_order():
    return W.partitionBy(*KEY).orderBy("y")


def settle(
    px: DataFrame,
    carry: list[str] | None = None,
    beside: DataFrame | None = None,
    totals: dict[str, tuple] | None = None,
    band_rows: int = BAND_ROWS,
    pages_only: bool = True,
    unused: list[str] | None = None,
    dealt: bool = False,
) -> DataFrame:
    """The same scanlines behind one shuffle by (page, band) that all their readers share.

    A page statistic and the scanlines it goes back to both start from here, and Spark runs the shuffle
    and what leads to it once. For that the readers' plans must agree up to the shuffle: all planes and
    the whole numbers in ``carry`` travel as one array, from which no reader drops its unused part, and
    come out of a window, below which no reader's filter sinks. The window's order is the one that
    neighbourhoods need anyway. Nothing runs before the result is asked for; rows without page are dropped, unless ``pages_only`` is off.

    ``beside`` has rows (page_id, band, y, value) that travel along: each scanline gets, as ``_beside``,
    the value of the last of them at or above it.

    ``totals`` are page statistics that sums or maxima of one whole number per scanline give, by name:
    (number, "sum", "min" or "max"), with a type where it is not a whole number. Each core scanline takes
    its numbers along and sends them to the other bands of its page in the same shuffle, where a window
    adds them up, so they need no join. Planes ``unused`` after that stay behind.

    Pages of one band (``by_size``) stay as they are: nothing of theirs has to travel. Scanlines that come
    from a join by page are ``dealt`` already; the readers then share the join's shuffle.
    """
    carry, totals = carry or [], totals or {}
    if whole(px) and beside is None and not totals:
        return px
    planes = [c for c in px.columns if c not in [*POSITION, *carry, *(unused or [])]]
    kinds = {f.name: f.dataType.simpleString() for f in px.schema.fields}
    # Where one plane has doubles all travel as such, which hold whole numbers of 32 bits as they are.
    like = "array<double>" if any(kinds[p] == "array<double>" for p in planes) else "array<int>"
    held_as = lambda c, kind: c.cast(kind) if like == "array<double>" else c
    head = F.array("h", "w", F.col("core").cast("int"), *[F.col(c).cast("int") for c in carry])
    packed, order = F.array(*[held_as(c, like) for c in (head, *map(F.col, planes))]), rows_in_order()
    rows = px.filter(F.col("page_id").isNotNull()) if pages_only else px
    if totals:
        type_of = {n: t[2] if len(t) > 2 else "bigint" for n, t in totals.items()}
        kind = "struct<" + ",".join(f"{n}:{k}" for n, k in type_of.items()) + ">"
        # Computed once, not within the lambda below.
        rows = rows.withColumns({f"_own_{n}": t[0].cast(type_of[n]) for n, t in totals.items()})
        parts = F.struct(*[F.col(f"_own_{n}").alias(n) for n in totals])
        own = F.when(F.col("core"), parts)
        line = F.struct(F.col("band").cast("int").alias("band"), packed.alias("_packed"), own.cast(kind).alias("_part"))
        last = F.floor((F.col("h") - 1) / band_rows).cast("int")
        sent = F.transform(
            F.filter(F.sequence(F.lit(0), last), lambda b: b != F.col("band")),
            lambda b: F.struct(b.alias("band"), F.lit(None).cast(f"array<{like}>").alias("_packed"), parts.alias("_part")),
        )
        every = F.when(F.col("core"), F.concat(F.array(line), sent)).otherwise(F.array(line))
        rows = rows.select("page_id", "y", F.inline_outer(every))
    else:
        # Spark drops a shuffle by the key that the rows are dealt by already; as a value of its own the
        # band does not tell that they are.
        rows = rows.select("page_id", F.abs("band").alias("band"), "y", packed.alias("_packed"))
    if beside is not None:
        others = beside.filter(F.col("page_id").isNotNull()).select(*KEY, F.col("y").cast("int").alias("y"), "value")
        rows = rows.unionByName(others, allowMissingColumns=True)
    if beside is not None or totals:
        order = W.partitionBy(*KEY).orderBy("y", F.col("_packed").isNotNull())
    held = {"_held": F.first("_packed").over(order.rowsBetween(0, 0))}
    if beside is not None:
        held["_beside"] = F.last("value", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    alike = W.partitionBy(*KEY)
    held |= {n: getattr(F, t[1])(F.col(f"_part.{n}")).over(alike) for n, t in totals.items()}
    shared = (rows if dealt else rows.repartition(*KEY)).withColumns(held)
    if beside is not None or totals:
        shared = shared.filter(F.col("_held").isNotNull())
    number = lambda i: held_as(F.get(F.get("_held", F.lit(0)), F.lit(i)), "int")
    settled = shared.select(
        *KEY, "y", number(0).alias("h"), number(1).alias("w"), (number(2) == 1).alias("core"),
        *[held_as(F.get("_held", F.lit(i + 1)), kinds[p]).alias(p) for i, p in enumerate(planes)],
        *[number(3 + i).alias(c) for i, c in enumerate(carry)],
        *(["_beside"] if beside is not None else []),
        *totals,
    )
    settled._settled = True
    return settled


def shared(px: DataFrame) -> DataFrame:
    """Scanlines that a page statistic and what it goes back to read from one shuffle: settled, rows
    without page kept, unless they are already or hold more than whole numbers."""
    planes = [f for f in px.schema.fields if f.name not in POSITION]
    if getattr(px, "_settled", False) or any(f.dataType.simpleString() != "array<int>" for f in planes):
        return px
    return settle(px, pages_only=False)


def pixels(px: DataFrame, *planes: str) -> DataFrame:
    """One row per pixel of the core rows: page_id, h, w, y, x and the planes."""
    zipped = F.arrays_zip(*[F.col(p) for p in planes])
    return (
        px.filter("core")
        .select("page_id", "h", "w", "y", F.posexplode(zipped).alias("x", "_p"))
        .select("page_id", "h", "w", "y", "x", *[F.col(f"_p.{p}").alias(p) for p in planes])
    )


# Pixels that a numpy step takes at once, so that its intermediate arrays stay small.
STEP_PIXELS = 1 << 21


def numbers_of(values: pa.Array) -> np.ndarray:
    """Values as numpy; with missing ones as doubles, NaN where missing."""
    if values.null_count:
        values = pc.cast(values, pa.float64())
    return values.to_numpy(zero_copy_only=False)


def typed(values: np.ndarray, kind: str) -> pa.Array:
    """Numpy values as Arrow ints, longs or doubles; NaN is missing."""
    to = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[kind]
    values = np.asarray(values)
    if values.dtype.kind != "f":
        return pa.array(values.astype(to.to_pandas_dtype(), copy=False))
    gone = np.isnan(values)
    if not gone.any():
        return pa.array(values.astype(to.to_pandas_dtype(), copy=False))
    return pa.array(np.where(gone, 0, values).astype(to.to_pandas_dtype()), mask=gone)


def lengths_of(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def listed(values: pa.Array, lengths: np.ndarray, like: pa.Array | None = None) -> pa.Array:
    """Flat values cut into lists, missing where ``like`` is."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    gone = None if like is None or not like.null_count else like.is_null()
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=gone)


def _spread(column: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """A row's number for each of its pixels; of a list, a row of its numbers, NaN beyond their end."""
    if not pa.types.is_list(column.type):
        return np.repeat(numbers_of(column), lengths)
    sizes = lengths_of(column)
    rows = np.full((len(sizes), int(sizes.max(initial=0)) + 1), np.nan)
    rows[np.arange(rows.shape[1])[None, :] < sizes[:, None]] = numbers_of(column.flatten())
    return np.repeat(rows, lengths, axis=0)


def _named(values, outputs: list[str]) -> list[np.ndarray]:
    return [values[o] for o in outputs] if isinstance(values, dict) else [values]


class Step(NamedTuple):
    """One operator on planes; ``near`` says that it looks at neighbours and gets arrays (band, row, x), and the
    numbers of rows in ``page`` as arrays (band, row)."""

    near: bool
    inputs: list[str]
    fn: Callable[..., np.ndarray | dict[str, np.ndarray]]
    outputs: list[str]
    page: list[str]
    types: list[str]


class Plane(NamedTuple):
    """A plane of many scanlines: flat values, pixels of each line, and an array missing where the line is."""

    values: pa.Array
    lengths: np.ndarray
    like: pa.Array


def plane_of(lines: pa.Array) -> Plane:
    return Plane(lines.flatten(), lengths_of(lines), lines)


def _pointwise(step: Step, planes: dict[str, Plane], column: Callable[[str], pa.Array]) -> list[np.ndarray]:
    lengths = planes[step.inputs[0]].lengths
    flat = [numbers_of(planes[i].values) for i in step.inputs]
    # A page's number that an earlier step took is there for each pixel.
    page = [numbers_of(planes[c].values) if c in planes else _spread(column(c), lengths) for c in step.page]
    return _named(step.fn(*flat, *page), step.outputs)


def _nearby(step: Step, planes: dict[str, Plane], column: Callable[[str], pa.Array], counts: np.ndarray) -> list[np.ndarray]:
    """``fn`` on bands of equal size at once, ``counts`` lines in each band."""
    widths = planes[step.inputs[0]].lengths
    flat = [numbers_of(planes[i].values) for i in step.inputs]
    rows = [numbers_of(column(c)) for c in step.page]
    first = np.cumsum(counts) - counts
    upto = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
    size, start = upto[first + counts] - upto[first], upto[first]
    wide = widths[first] if len(widths) else counts * 0
    if (wide * counts != size).any():
        raise ValueError("the lines of a band differ in width")
    found = [np.zeros(len(flat[0]), dtype=np.float64 if k == "double" else np.int64) for k in step.types]
    for n, w in set(zip(counts.tolist(), wide.tolist())):
        if n * w == 0:
            continue
        at = np.flatnonzero((counts == n) & (wide == w))
        most = max(1, STEP_PIXELS // (n * w))
        for some in (at[i : i + most] for i in range(0, len(at), most)):
            if some[-1] - some[0] + 1 == len(some) and start[some[-1]] - start[some[0]] == (len(some) - 1) * n * w:
                pick = slice(start[some[0]], start[some[0]] + len(some) * n * w)
            else:
                pick = (start[some][:, None] + np.arange(n * w)).ravel()
            lines = first[some][:, None] + np.arange(n)
            done = _named(step.fn(*[v[pick].reshape(len(some), n, w) for v in flat], *[v[lines] for v in rows]), step.outputs)
            for i, v in enumerate(done):
                if v.dtype.kind == "f" and found[i].dtype.kind != "f":
                    found[i] = found[i].astype(np.float64)
                found[i][pick] = v.reshape(-1)
    return found


def work(
    steps: list[Step], planes: dict[str, Plane], column: Callable[[str], pa.Array], kept: list[str], counts: np.ndarray | None = None
) -> None:
    """Runs the steps one after the other and adds their planes. Planes that neither a later step nor
    ``kept`` names are let go."""
    for i, step in enumerate(steps):
        with np.errstate(all="ignore"):
            found = _nearby(step, planes, column, counts) if step.near else _pointwise(step, planes, column)
        first = planes[step.inputs[0]]
        for name, values, kind in zip(step.outputs, found, step.types):
            planes[name] = Plane(typed(values, kind), first.lengths, first.like)
        del found
        later = {c for s in steps[i + 1 :] for c in (*s.inputs, *s.page)}
        for name in planes.keys() - later - set(kept):
            del planes[name]


def text_of(plane: Plane) -> pa.Array:
    """Each line's whole numbers as text with commas, without missing ones."""
    values, lengths = plane.values, plane.lengths
    if values.null_count:
        known = pc.is_valid(values).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(known)])
        ends = np.cumsum(lengths)
        values, lengths = values.drop_null(), upto[ends] - upto[ends - lengths]
    distinct = values.dictionary_encode()  # few values, so that each is written once
    words = pc.cast(distinct.dictionary, pa.string()).take(distinct.indices)
    return pc.binary_join(listed(words, lengths, plane.like), ",")


def _used(steps: list[Step], wanted: list[str]) -> tuple[list[Step], set[str]]:
    """The steps that ``wanted`` needs, and the columns that these need."""
    need, kept = set(wanted), []
    for step in reversed(steps):
        if need & set(step.outputs):
            need = (need - set(step.outputs)) | set(step.inputs) | set(step.page)
            kept.insert(0, step)
    return kept, need


def _then(px: DataFrame, step: Step) -> DataFrame:
    base, steps = getattr(px, "_chain", (px, []))
    made = {o for s in steps for o in s.outputs}
    if made & set(step.page) and not whole(px):
        base, steps = px, []
    columns = px.columns
    return chained(base, [*steps, step], [*columns, *[o for o in step.outputs if o not in columns]])


def chained(base: DataFrame, steps: list[Step], columns: list[str], texts: list[str] | None = None) -> DataFrame:
    """``columns`` of the scanlines after ``steps``, which run together in one Python step.

    The result remembers the steps, so a further one joins them: planes between operators stay numpy
    arrays and bands are gathered once. With ``texts``, these planes come as text.
    """
    ship(base.sparkSession)
    texts = texts or []
    used, need = _used(steps, [*columns, *texts])
    inputs = [c for c in base.columns if c in need or c in KEY or c == "y"]
    fed, used = _led(base.select(*inputs), used, [*columns, *texts])
    made = {o: k for s in used for o, k in zip(s.outputs, s.types)}
    kinds = {"long": "bigint"}
    kind_of = {c: f"array<{kinds.get(made[c], made[c])}>" for c in made} | {c: "string" for c in texts}
    if any(s.near for s in used):
        out = _bands_worked(fed, used, made, kind_of, columns, texts)
    else:
        out = _lines_worked(fed, used, made, kind_of, columns, texts)
    if not texts:
        out._chain = (base, steps)
    if hasattr(base, "_whole"):
        out._whole = base._whole
    return out


def _led(base: DataFrame, steps: list[Step], wanted: list[str]) -> tuple[DataFrame, list[Step]]:
    """``base`` after the first pointwise steps, where fewer planes are left for the shuffle by band after them."""
    first = next((i for i, s in enumerate(steps) if s.near), 0)
    lists = lambda columns: sum(c not in POSITION for c in columns)
    if not first:
        return base, steps
    lead, rest, inputs = steps[:first], steps[first:], base.columns
    need = _used(rest, wanted)[1]
    made = {o: k for s in lead for o, k in zip(s.outputs, s.types)}
    kept = [*[c for c in inputs if c in need or c in KEY or c == "y"], *[o for o in made if o in need and o not in inputs]]
    if lists(kept) >= lists(inputs):
        return base, steps
    kinds = {o: f"array<{'bigint' if k == 'long' else k}>" for o, k in made.items()}
    return _lines_worked(base, lead, made, kinds, kept, []), rest


def _lines_worked(base, steps, made, kind_of, columns, texts) -> DataFrame:
    lists = [c for c in dict.fromkeys([*[i for s in steps for i in s.inputs], *texts]) if c in base.columns]
    page = [c for c in dict.fromkeys(c for s in steps for c in s.page) if c not in lists]
    results = [*[c for c in columns if c in made and c not in texts], *texts]
    if not results:
        return base.select(*columns)

    def run(*given: pa.Array) -> pa.Array:
        held = dict(zip([*lists, *page], given))
        planes = {c: plane_of(held[c]) for c in lists}
        work(steps, planes, held.__getitem__, results)
        done = [
            text_of(planes[c]) if c in texts else listed(planes[c].values, planes[c].lengths, planes[c].like) for c in results
        ]
        return pa.StructArray.from_arrays(done, names=results)

    schema = "struct<" + ",".join(f"`{c}`:{kind_of[c]}" for c in results) + ">"
    mapped = F.arrow_udf(run, schema)(*[F.col(c) for c in [*lists, *page]])
    worked = base.withColumn("_mapped", mapped)
    order = [*[c for c in columns if c not in texts], *texts]
    return worked.select(*[F.col("_mapped").getField(c).alias(c) if c in results else F.col(c) for c in order])


# Bytes of scanlines that are gathered before whole bands among them are worked on.
GATHERED_BYTES = 4 << 20


def _band_starts(lines: pa.Table) -> np.ndarray:
    """Where a new (page, band) begins in sorted scanlines."""
    new = np.zeros(len(lines), dtype=bool)
    new[:1] = True
    for c in KEY:
        v = lines.column(c).combine_chunks()
        a, b = v.slice(1), v.slice(0, max(len(v) - 1, 0))
        gone = lambda x: x.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (gone(a) != gone(b))
    return np.flatnonzero(new)


def whole_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted scanlines as tables of whole bands, with the lines of each band."""
    held, size, most = [], 0, GATHERED_BYTES
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        lines = pa.Table.from_batches(held)
        starts = _band_starts(lines)
        if len(starts) < 2:
            most = 2 * size
            continue
        yield lines.slice(0, starts[-1]), np.diff(starts)
        rest = lines.slice(starts[-1]).combine_chunks()
        held, most = rest.to_batches(), GATHERED_BYTES
        size = 0  # the rest is less than one more band
    if held:
        lines = pa.Table.from_batches(held)
        if len(lines):
            yield lines, np.diff([*_band_starts(lines), len(lines)])


def _bands_worked(base, steps, made, kind_of, columns, texts) -> DataFrame:
    order = [*[c for c in columns if c not in texts], *texts]
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields} | kind_of
    schema = ",".join(f"`{c}` {kinds[c]}" for c in order)
    lists = [c for c in dict.fromkeys([*[i for s in steps for i in s.inputs], *texts]) if c in base.columns]
    results = [c for c in order if c in made or c in texts]

    def run(batches):
        for lines, counts in whole_bands(batches):
            column = lambda c: lines.column(c).combine_chunks()
            planes = {c: plane_of(column(c)) for c in lists}
            work(steps, planes, column, results, counts)
            done = [
                text_of(planes[c]) if c in texts
                else listed(planes[c].values, planes[c].lengths, planes[c].like) if c in made else column(c)
                for c in order
            ]
            yield pa.RecordBatch.from_arrays(done, names=order)

    # A window has Spark deal and sort the rows by band, but only those that it does not know to be so already.
    return base.withColumn("_row", F.row_number().over(rows_in_order())).mapInArrow(run, schema)


def only(px: DataFrame, columns: list[str]) -> DataFrame:
    """Some columns of the scanlines; steps that nothing needs any more are left out."""
    if hasattr(px, "_parts"):
        return _apart([only(part, columns) for part in px._parts])
    if hasattr(px, "_chain"):
        return chained(*px._chain, columns)
    chosen = px.select(*columns)
    if hasattr(px, "_whole"):
        chosen._whole = px._whole
    return chosen


def without(px: DataFrame, *columns: str) -> DataFrame:
    return only(px, [c for c in px.columns if c not in columns])


def as_text(px: DataFrame, *planes: str) -> DataFrame:
    """Core rows (page_id, y) with each plane of whole numbers as text."""
    if hasattr(px, "_parts"):
        small, large = (as_text(part, *planes) for part in px._parts)
        return small.unionByName(large)
    base, steps = getattr(px, "_chain", (px, []))
    if not any(s.near for s in _used(steps, list(planes))[0]):
        base = base.filter("core")
    return chained(base, steps, ["page_id", "y", "core"], list(planes)).filter("core").drop("core")


def map_planes(
    px: DataFrame,
    inputs: list[str],
    fn: Callable[..., np.ndarray | dict[str, np.ndarray]],
    outputs: list[str],
    page: list[str] | None = None,
    kinds: dict[str, str] | None = None,
) -> DataFrame:
    """Pointwise operator on the pixels of many scanlines at once.

    ``fn`` gets each input plane as one flat numpy array, then the row's numbers in the columns ``page``
    repeated for its pixels, and returns the output plane or a dict of them. ``kinds`` names outputs that
    are not ``int``. Missing pixels are NaN.
    """
    return _then(px, Step(False, inputs, fn, outputs, page or [], [(kinds or {}).get(o, "int") for o in outputs]))


def line_total(px: DataFrame, inputs: list[str], fn: Callable[..., np.ndarray], how: str = "sum") -> Column:
    """The sum (or ``max``) over each scanline of what ``fn`` makes of its pixels."""
    ship(px.sparkSession)
    reduced = np.add if how == "sum" else np.maximum

    def run(*columns: pa.Array) -> pa.Array:
        lengths = lengths_of(columns[0])
        values = np.asarray(fn(*[numbers_of(c.flatten()) for c in columns])).astype(np.float64)
        out = np.full(len(lengths), 0.0 if how == "sum" else np.nan)
        some = lengths > 0
        starts = (np.cumsum(lengths) - lengths)[some]
        if len(starts):
            out[some] = reduced.reduceat(values, starts)
        return typed(out, "long")

    return F.arrow_udf(run, "bigint")(*[F.col(c) for c in inputs])


def map_bands(
    px: DataFrame,
    inputs: list[str],
    fn: Callable[..., np.ndarray | dict[str, np.ndarray]],
    outputs: list[str],
    kinds: dict[str, str] | None = None,
    page: list[str] | None = None,
) -> DataFrame:
    """Neighbourhood operator: ``fn`` gets each input plane of bands of equal size as one array (band, row, x),
    then the rows' numbers in the columns ``page`` as arrays (band, row).

    The scanlines are dealt by band and sorted, and Python takes whole bands from them; neighbourhood
    and pointwise operators that follow one another do so once. Rows come in the order of ``y``.
    """
    return _then(px, Step(True, inputs, fn, outputs, page or [], [(kinds or {}).get(o, "int") for o in outputs]))


def attach(px: DataFrame, stats: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """Add page-level columns of ``stats(page_id, h, …)`` to every row of the page.

    Statistics are repeated per band, so the join uses the key the scanlines are partitioned by and
    the scanlines do not move again.
    """
    last = F.floor((F.col("h") - 1) / band_rows).cast("int")
    spread = stats.withColumn("band", F.explode(F.sequence(F.lit(0), last))).drop("h")
    # The size check would take statistics, made from a few bytes a page, for a small table.
    return px.hint("merge").join(spread.hint("merge"), KEY, "left")


# --- neighbours ----------------------------------------------------------------------------------
# On arrays (band, row, x) of bands of equal size, as ``map_bands`` gives them. At the outer edge of a
# margin what stands in for rows beyond is meaningless, which is what margins are for.


def padded(stack: np.ndarray, rows: int, columns: int, border: str = "replicate") -> np.ndarray:
    """The stack with rows and columns repeated or mirrored beyond its edges."""
    modes = {"replicate": "edge", "reflect": "reflect"}
    return np.pad(stack, ((0, 0), (rows, rows), (columns, columns)), mode=modes[border])


def weighted(stack: np.ndarray, weights: list[float], border: str = "replicate") -> np.ndarray:
    """Weighted sums along each line, then across rows, in doubles."""
    r, (_, n, w) = len(weights) // 2, stack.shape
    wide = padded(stack, 0, r, border).astype(np.float64)
    lined = wide[:, :, :w] * weights[0]
    for k in range(1, len(weights)):
        lined += wide[:, :, k : k + w] * weights[k]
    tall = padded(lined, r, 0, border)
    out = tall[:, :n] * weights[0]
    for k in range(1, len(weights)):
        out += tall[:, k : k + n] * weights[k]
    return out


def box_total(stack: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of ``2r+1``, edges repeated, by differences of running sums."""
    out = stack if stack.dtype.kind == "f" else stack.astype(np.int64)
    for axis in (2, 1):
        wide = padded(out, r * (axis == 1), r * (axis == 2))
        running = np.cumsum(wide, axis=axis)
        first = np.take(running, [2 * r], axis=axis)
        ahead = np.delete(running, np.s_[: 2 * r + 1], axis=axis)
        behind = np.take(running, np.arange(running.shape[axis] - 2 * r - 1), axis=axis)
        out = np.concatenate([first, ahead - behind], axis=axis)
    return out
