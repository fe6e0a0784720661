"""A handle: a lazy, ordered selection of a dataset's spectra.

A handle is a frame of variables with ord_, the order of its spectra. Filters add conditions, subsets and merges joins;
nothing runs before a result is asked for, and Catalyst merges the conditions, prunes the columns and pushes what it can
into the scan. Every result is in handle order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.errors import CapabilityError, ReadOnlyError, ReferenceError, SemanticError, UnsupportedError
from spectrail.functions import peaks as pk
from spectrail.functions import predicates as pr
from spectrail.functions.order import with_position
from spectrail.sources import manifest as mf
from spectrail.sources import runs as rn
from spectrail.sources.dataset import Dataset, union_by_name

#: Up to so many ids are written into the condition; more are joined. Up to so many joined ids are broadcast.
INLINE, BROADCAST = 200, 100_000
HIDDEN = ("ord_", "_time")


class Handle:
    """span: what ord_, a number from 0, stays below, if that is known; results then need no look at the data to be put in order."""

    def __init__(self, data: Dataset, frame: DataFrame, *, full: bool = False, overlay: frozenset[str] = frozenset(), log: tuple = (), span: int | None = None, names: list[str] | None = None) -> None:
        self.data, self.frame, self.full, self.overlay, self.log, self.span, self._names = data, frame, full, overlay, log, span, names

    @property
    def names(self) -> list[str]:
        """The frame's columns."""
        if self._names is None:
            self._names = self.frame.columns
        return self._names

    def _sorted(self, rows: DataFrame, key: str = "ord_", *more: str) -> DataFrame:
        """Rows in handle order. With a known span they are dealt by ranges of it at once; without, Spark reads the rows first to find ranges."""
        if self.span is None:
            return rows.orderBy(key, *more)
        parts = int(self.data.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartitionById(parts, F.floor(F.col(key) * F.lit(float(parts)) / F.lit(float(max(1, self.span)))).cast("int")).sortWithinPartitions(key, *more)

    @classmethod
    def of(cls, data: Dataset, cached: bool = False) -> Handle:
        from spectrail.operators import cache

        frame = cache.whole(data) if cached else data.view()
        span = mf.n_spectra(data.manifest) + 1 if data.path is not None else None
        return cls(data, frame.withColumn("ord_", F.col("spectrum_id_").cast("long")), full=True, span=span)

    def _with(self, frame: DataFrame, step: tuple | None = None, **more) -> Handle:
        log = None if step is None or self.log is None else (*self.log, step)
        return Handle(self.data, frame, full=False, overlay=self.overlay, log=log, span=more.get("span", self.span), names=more.get("names"))

    def __reduce__(self):
        """A pickled handle is its dataset's path and the steps taken."""
        if self.log is None:
            raise CapabilityError("this handle holds data of its own and can't be pickled")
        return _replay, (self.data, self.log)

    def __repr__(self) -> str:
        return f"<Handle of {self.data.path or 'frames'}: {self.data.kind}, {'all spectra' if self.full else 'a selection'}>"

    # -- filters

    def _where(self, test: Column, step: tuple) -> Handle:
        return self._with(self.frame.where(test), step, names=self._names)

    def filter_ms_level(self, *levels: int) -> Handle:
        """Spectra of these levels; without levels all stay. A null level is none."""
        return self if not levels else self._where(pr.member(F.col("msLevel"), levels), ("filter_ms_level", levels))

    def filter_rt(self, *rt: float, ms_level: Sequence[int] | int | None = None) -> Handle:
        """Retention times from the least to the greatest of `rt`, both included; an infinite bound is none.

        With ms_level, only spectra of those levels are tested; others, and those of unknown level, stay.
        """
        if not rt:
            return self
        low, high = pr.span(rt)
        inside = pr.in_range(F.col("rtime"), low, high)
        if low == float("-inf") and high == float("inf"):
            return self
        step = ("filter_rt", rt, {"ms_level": ms_level})
        if ms_level is not None:
            levels = [ms_level] if isinstance(ms_level, int) else list(ms_level)
            tested = pr.surely(pr.member(F.col("msLevel"), levels))
            return self._where((inside & tested) | ~tested, step)
        if "_time" in self.names and "rtime" not in self.overlay:
            inside = pr.widened(F.col("_time"), low, high, 60.0) & inside
        return self._where(inside, step)

    def filter_data_origin(self, *origins: str) -> Handle:
        """Spectra of these origins; of several, in the order given and within one in handle order."""
        if not origins:
            return self
        test, column = pr.member(F.col("dataOrigin"), origins), F.col("dataOrigin")
        if self.data.path is not None and "dataOrigin" not in self.overlay:
            sources = {r["source"]: r["run_id"] for r in mf.run_table(self.data.path) if r["source"] is not None}
            if sources and len(sources) == len(self.data.run_ids):  # whole runs: their directories are chosen
                test = pr.member(F.col("run_id"), [sources[o] for o in origins if o in sources])
        out = self._where(test, ("filter_data_origin", origins))
        if len(origins) > 1:
            place = F.array_position(F.array(*[F.lit(o) for o in dict.fromkeys(origins)]), column)
            frame = out.frame.withColumn("ord_", F.struct(place.alias("p"), F.col("ord_").alias("o")))
            out = Handle(out.data, frame, overlay=out.overlay, log=out.log, names=out._names)
        return out

    def filter_precursor_mz_range(self, *mz: float) -> Handle:
        if not mz:
            return self
        low, high = pr.span(mz)
        test = F.col("precursorMz").isNotNull() & ~F.isnan("precursorMz") & pr.in_range(F.col("precursorMz"), low, high)
        return self._where(test, ("filter_precursor_mz_range", mz))

    def filter_precursor_mz_values(self, mz: Sequence[float], ppm=20.0, tolerance=0.0) -> Handle:
        """Precursors within mz * ppm / 10^6 + tolerance of some value. Many windows are joined by ranges."""
        if not mz:
            return self
        ranges, step = pr.windows(mz, ppm, tolerance), ("filter_precursor_mz_values", (list(mz), ppm, tolerance))
        if len(ranges) > INLINE:
            return self._with(in_some(self.frame, "precursorMz", ranges), step)
        return self._where(pr.either([pr.in_range(F.col("precursorMz"), a, b) for a, b in ranges]), step)

    def filter_contains_mz(self, mz: Sequence[float] | float, tolerance=0.0, ppm=20.0, *, allow_native: bool = False) -> Handle:
        """Spectra with a peak in some window. On archives one scan of the points, or of their sorted copy if all runs have it."""
        mz = [mz] if isinstance(mz, (int, float)) else list(mz)
        if not mz:
            return self
        ranges = pr.windows(mz, ppm, tolerance)
        step = ("filter_contains_mz", (mz, tolerance, ppm), {"allow_native": allow_native})
        if self.data.kind == "native":
            if not allow_native:
                raise UnsupportedError("filter_contains_mz needs points; pass allow_native=True to search peak lists", kind="native")
            if "mz" in self.names:
                return self._where(pk.holds("mz", ranges), step)
            found = self.data.lists("mz").where(pk.holds("mz", ranges)).select("run_id", "spectrum_id_")
            return self._with(self.frame.join(found, ["run_id", "spectrum_id_"], "left_semi"), step)
        from spectrail.operators.projection import search_points

        found = search_points(self.data).where(pr.either([pr.in_range(F.col("mz"), a, b) for a, b in ranges])).select("spectrum_id_").distinct()
        return self._with(self.frame.join(found, "spectrum_id_", "left_semi"), step)

    def filter_sample_data(self, test: Column | str) -> Handle:
        """Spectra of the runs whose sample row passes; a null outcome does not."""
        samples = self.data.samples()
        if not self.data.sample_variables():
            raise CapabilityError("the dataset has no sample table")
        try:
            flagged = samples.select("run_id", (F.expr(test) if isinstance(test, str) else test).alias("ok"))
            kind = dict(flagged.dtypes)["ok"]
        except Exception as e:  # noqa: BLE001
            raise SemanticError(f"the test can't be applied to the sample table: {e}") from e
        if kind != "boolean":
            raise SemanticError(f"the test gives {kind}, not one boolean a row", type=kind)
        step = ("filter_sample_data", (test,)) if isinstance(test, str) else None
        runs = [r.run_id for r in flagged.where("ok").collect()]  # at most one row a run
        if self.data.path is None:
            return self._with(self.frame.where(pr.member(F.col("run_id"), runs)), step)
        inside = pr.either([F.col("spectrum_id_").between(a, b) for a, b in rn.id_ranges(self.data.manifest, set(runs))])
        return self._with(self.frame.where(pr.member(F.col("run_id"), runs) & inside), step)

    # -- selection

    def take(self, index: Sequence) -> Handle:
        """Spectra by place (from 0), by flag, or by name (the id as text); order and repeats are kept."""
        index = list(index)
        if index and all(isinstance(i, bool) for i in index):
            index = [i for i, keep in enumerate(index) if keep]
        step = ("take", (index,))
        if index and all(isinstance(i, str) for i in index):
            if bad := [i for i in index if not i.isdecimal()]:
                raise ReferenceError(f"no spectra named {bad[:5]}", names=bad)
            ids = [int(i) for i in index]
            wanted = self._table(sorted(set(ids)))
            if bad := [r[0] for r in wanted.join(self.frame, wanted["_key"] == self.frame["spectrum_id_"], "left_anti").select("_key").limit(5).collect()]:
                raise ReferenceError(f"no spectra named {bad}", names=bad)
            return self._by_ids(ids, step)
        n = self.count() if index else 0
        if bad := [i for i in index if not 0 <= i < n]:
            raise ReferenceError(f"there are {n} spectra; no places {bad[:5]}", index=bad)
        if self.full:
            return self._by_ids([i + 1 for i in index], step)
        placed = with_position(self.frame, "ord_", "_at")
        return self._with(self._ordered(placed, "_at", index), step, span=len(index))

    __getitem__ = take

    def _by_ids(self, ids: list[int], step: tuple | None = None) -> Handle:
        rising = all(a < b for a, b in zip(ids, ids[1:]))
        if not ids:
            return self._with(self.frame.where(F.lit(False)), step)
        if rising and self.full:
            if ids[-1] - ids[0] == len(ids) - 1:
                return self._with(self.frame.where(F.col("spectrum_id_").between(ids[0], ids[-1])), step)
            if len(ids) <= INLINE:
                return self._with(self.frame.where(F.col("spectrum_id_").isin(ids)), step)
        return self._with(self._ordered(self.frame.withColumn("_at", F.col("spectrum_id_").cast("long")), "_at", ids), step, span=len(ids))

    def _ordered(self, frame: DataFrame, key: str, wanted: list[int]) -> DataFrame:
        """Rows whose key is wanted, as often and in the order that it is."""
        some = self._table(wanted)
        return frame.join(some, F.col(key) == F.col("_key")).withColumn("ord_", F.col("_new")).drop(key, "_key", "_new")

    def _table(self, keys: list[int]) -> DataFrame:
        """_key and _new (its place), broadcast if there are few."""
        import pyarrow as pa

        some = self.data.spark.createDataFrame(pa.table({"_key": pa.array(keys, pa.int64()), "_new": pa.array(range(len(keys)), pa.int64())}))
        return F.broadcast(some) if len(keys) <= BROADCAST else some

    def merge(self, *others: Handle) -> Handle:
        """The spectra of all handles of one dataset, one after another; overlaid columns are filled with nulls where absent."""
        if any(o.data is not self.data and (o.data.path is None or o.data.path != self.data.path) for o in others):
            raise SemanticError("only handles of one dataset can be merged")
        frames, whole = [], [self, *others]
        for i, h in enumerate(whole):
            flat = h.frame if dict(h.frame.dtypes)["ord_"] == "bigint" else h.placed("ord_")
            frames.append(flat.withColumn("_part", F.lit(i).cast("long")))
        both = union_by_name(frames)
        both = both.withColumn("ord_", F.struct(F.col("_part").alias("p"), F.col("ord_").alias("o"))).drop("_part")
        return Handle(self.data, both, overlay=reduce(lambda a, h: a | h.overlay, whole, frozenset()), log=None)

    def with_column(self, name: str, values: Sequence | Column) -> Handle:
        """A column of the handle alone, which hides one of that name in the dataset; a value for each spectrum, in order."""
        if name in ("spectrum_id_", "mz", "intensity", *HIDDEN):
            raise ReadOnlyError(f"{name} can't be replaced", column=name)
        if isinstance(values, Column):
            frame = self.frame.withColumn(name, values)
        else:
            values = list(values)
            placed = with_position(self.frame.drop(name), "ord_", "_at")
            import pandas as pd

            own = self.data.spark.createDataFrame(pd.DataFrame({"_at": range(len(values)), name: pd.Series(values)}))
            if (n := self.count()) != len(values):
                raise SemanticError(f"{len(values)} values for {n} spectra", column=name)
            frame = placed.join(F.broadcast(own) if len(values) <= BROADCAST else own, "_at", "left").drop("_at")
        return Handle(self.data, frame, full=self.full, overlay=self.overlay | {name}, log=None, span=self.span)

    def placed(self, name: str = "place") -> DataFrame:
        """The frame with each spectrum's place in the handle, from 0."""
        return with_position(self.frame, "ord_", "_at").withColumn(name, F.col("_at")).drop("_at")

    def reset(self) -> Handle:
        return self.data.spectra()

    # -- results

    def variables(self) -> list[str]:
        own = [c for c in self.names if c not in HIDDEN]
        return [*own, *[c for c in self.data.sample_variables() if c not in own], *([] if "mz" in own else ["mz", "intensity"])]

    def ids(self) -> DataFrame:
        return self._sorted(self.frame.select("ord_", "spectrum_id_")).select("spectrum_id_")

    def count(self) -> int:
        """Of all spectra from the manifest; of a selection by a scan."""
        if self.full and self.data.path is not None:
            return mf.n_spectra(self.data.manifest)
        return self.frame.count()

    def _columns(self, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        """The named variables and `keep`: overlaid and disk columns, then sample columns, then peaks."""
        frame, have = self.frame, set(self.names)
        missing = [c for c in names if c not in have]
        if self.log is not None and self.data.path is not None and self.data.kind == "native" and any(c in pk_names(self) for c in missing):
            # Lists are not kept in memory: one scan with the same filters has both, a join would read them all.
            return _replay(self.data, self.log)._columns(names, keep)
        if missing:
            samples = self.data.samples()
            if extra := [c for c in missing if c in samples.columns]:
                rows = samples.select("run_id", *extra)  # a row a run
                few = self.data.path is not None and len(self.data.run_ids) <= BROADCAST
                frame = frame.join(F.broadcast(rows) if few else rows, "run_id", "left")
            if wanted := [c for c in missing if c in pk_names(self)]:
                frame = self._with_points(frame, wanted)
            if unknown := [c for c in missing if c not in extra and c not in wanted]:
                raise SemanticError(f"no variables {unknown}", columns=unknown)
        flags = {"centroided", "smoothed"}
        return frame.select(*keep, *[F.col(f"`{c}`").cast("boolean").alias(c) if c in flags else F.col(f"`{c}`") for c in names])

    def _with_points(self, frame: DataFrame, wanted: list[str]) -> DataFrame:
        """Lists gathered from the points of the frame's spectra; none: empty."""
        if self.data.kind == "native":  # by run as well, so that only the directories of selected runs are read
            return frame.join(self.data.lists(*wanted), ["run_id", "spectrum_id_"], "left")
        frame = frame.join(pk.gathered(self._own_points(), "spectrum_id_"), "spectrum_id_", "left")
        return frame.withColumns({c: pk.listed(c) for c in wanted})

    def _own_points(self) -> DataFrame:
        """Points of an archive's spectra that are in the handle: others go before anything is grouped."""
        points = self.data.points()
        return points if self.full else points.join(self.frame.select("spectrum_id_"), "spectrum_id_", "left_semi")

    def spectra_data(self, *columns: str) -> DataFrame:
        """The variables (all without names), one row a spectrum, in handle order."""
        columns = columns or tuple(self.variables())
        return self._sorted(self._columns(columns, [F.col("ord_").alias("_o")]), "_o").select(*[F.col(f"`{c}`") for c in columns])

    def peak_variables(self) -> list[str]:
        return self.data.peak_variables()

    def peaks_data(self, *columns: str, long: bool = False) -> DataFrame:
        """spectrum_id_ and peaks, an array of structs of the columns (mz and intensity without names), or a row a peak with peak_ from 0.

        Lists are as long as the longest; null lists give nulls.
        """
        columns = columns or ("mz", "intensity")
        if unknown := [c for c in columns if c not in self.peak_variables()]:
            raise UnsupportedError(f"no peak columns {unknown}", columns=unknown)
        need = list(dict.fromkeys([*columns, "mz"]))
        rows = self._columns(need, ["ord_", "spectrum_id_"])
        zipped = pk.packed(*need)
        rows = rows.select("ord_", "spectrum_id_", F.transform(zipped, lambda p: F.struct(*[p[c].alias(c) for c in columns])).alias("peaks"))
        if long:
            rows = rows.select("ord_", "spectrum_id_", F.posexplode("peaks").alias("peak_", "p")).select("ord_", "spectrum_id_", "peak_", "p.*")
            return self._sorted(rows, "ord_", "peak_").drop("ord_")
        return self._sorted(rows).drop("ord_")

    def mz(self) -> DataFrame:
        return self.spectra_data("mz")

    def intensity(self) -> DataFrame:
        return self.spectra_data("intensity")

    def tic(self, initial: bool = True) -> DataFrame:
        """totIonCurrent as stored, or the sum of the intensities."""
        if initial:
            return self.spectra_data("spectrum_id_", "totIonCurrent").withColumnRenamed("totIonCurrent", "tic")
        return self.ion_count().withColumnRenamed("ionCount", "tic")

    def ion_count(self) -> DataFrame:
        if self.data.kind != "native":  # sums need no lists
            sums = self._own_points().groupBy("spectrum_id_").agg(F.sum("intensity").alias("s"))
            rows = self.frame.select("ord_", "spectrum_id_").join(sums, "spectrum_id_", "left")
            return self._sorted(rows.select("ord_", "spectrum_id_", F.coalesce("s", F.lit(0.0)).alias("ionCount"))).drop("ord_")
        rows = self._columns(["intensity"], ["ord_", "spectrum_id_"])
        return self._sorted(rows.select("ord_", "spectrum_id_", pk.summed().alias("ionCount"))).drop("ord_")

    def lengths(self) -> DataFrame:
        return self._sorted(self._columns(["mz"], ["ord_", "spectrum_id_"]).select("ord_", "spectrum_id_", pk.count().alias("n_peaks"))).drop("ord_")

    def contains_mz(self, mz: Sequence[float] | float, tolerance=0.0, ppm=20.0) -> DataFrame:
        """Whether each spectrum has a peak in some window."""
        mz = [mz] if isinstance(mz, (int, float)) else list(mz)
        ranges = pr.windows(mz, ppm, tolerance)
        if self.data.kind == "native":
            rows = self._columns(["mz"], ["ord_", "spectrum_id_"]).select("ord_", "spectrum_id_", pk.holds("mz", ranges).alias("contains"))
        else:
            hits = self._own_points().where(pr.either([pr.in_range(F.col("mz"), a, b) for a, b in ranges])).select("spectrum_id_", F.lit(True).alias("_hit")).distinct()
            rows = self.frame.select("ord_", "spectrum_id_").join(hits, "spectrum_id_", "left").select("ord_", "spectrum_id_", F.col("_hit").isNotNull().alias("contains"))
        return self._sorted(rows).drop("ord_")

    def split(self, name: str) -> dict:
        """A handle for each value of a variable (a null is one), in order of the values. The dictionary is as long as there are values."""
        values = [r[0] for r in self.frame.select(name).distinct().orderBy(name).collect()]
        return {v: self._with(self.frame.where(F.col(name).eqNullSafe(F.lit(v)))) for v in values}

    def unique_ms_levels(self) -> list[int]:
        return list(self.frame.agg(F.array_sort(F.collect_set("msLevel"))).first()[0])  # levels are few

    def _one(self, name: str, kind: str) -> DataFrame:
        c = F.col(name) if name in self.names else F.lit(None)
        return self._sorted(self.frame.select("ord_", c.cast(kind).alias(name))).drop("ord_")

    def prec_scan_num(self) -> DataFrame:
        return self._one("precScanNum", "int")

    def centroided(self) -> DataFrame:
        return self._one("centroided", "boolean")

    def smoothed(self) -> DataFrame:
        return self._one("smoothed", "boolean")

    def spectra_names(self) -> DataFrame:
        return self.ids().select(F.col("spectrum_id_").cast("string").alias("name"))

    def data_storage(self) -> DataFrame:
        return self._one("dataStorage", "string")

    def flat(self, column: str = "mz") -> DataFrame:
        """One peak column of all spectra, one after another, in handle order, with the spectrum and the peak's place in it."""
        return self.peaks_data(column, long=True)

    def as_view(self, name: str) -> str:
        """Registers the handle's variables as a temporary view for SQL; gives its name. `drop_view` forgets it."""
        self.frame.select(*[c for c in self.names if c not in HIDDEN]).createOrReplaceTempView(name)
        return name

    def drop_view(self, name: str) -> bool:
        return self.data.spark.catalog.dropTempView(name)

    def summary(self) -> dict:
        """What `repr` shows: where the spectra are, of what kind, how many runs, what signal an archive gives."""
        data = self.data
        return {"path": data.path, "kind": data.kind, "runs": len(data.run_ids) if data.path else None, "representation": data.representation if data.kind == "archive" else None}

    @staticmethod
    def supports_write_to() -> bool:
        return True

    @staticmethod
    def options(spark) -> dict:
        """Threads and memory are the session's: what it was given for them."""
        get = spark.conf.get
        return {"parallelism": spark.sparkContext.defaultParallelism, "partitions": int(get("spark.sql.shuffle.partitions")), "memory": get("spark.executor.memory", None) or get("spark.driver.memory", "1g")}

    def write_to(self, path: str, **how) -> Handle:
        """The spectra, in handle order and with what is overlaid, as a new native dataset."""
        from spectrail.operators.writer import write_native

        names = [c for c in self.variables() if c not in ("run_id", "dataStorage", *self.data.sample_variables())]
        rows = self._columns([c for c in dict.fromkeys([*names, "mz", "intensity"])], [F.col("ord_").alias("_order")])
        write_native(rows.drop("spectrum_id_"), path, order_by="_order", **how)
        return Dataset.open(self.data.spark, path).spectra()


def in_some(frame: DataFrame, column: str, ranges: list[tuple[float, float]]) -> DataFrame:
    """Rows whose value lies in one of many ranges: a range join by bins.

    Overlapping ranges are made one, so a value is in one at most; each range is listed under every bin that it touches, and a
    row looks under its own. Bins are as wide as a range on average, so there are about twice as many entries as ranges.
    """
    spark, merged = frame.sparkSession, []
    for a, b in sorted(r for r in ranges if r[0] <= r[1]):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    if not merged:
        return frame.where(F.lit(False))
    width = max(1e-6, sum(b - a for a, b in merged) / len(merged))
    entries = spark.createDataFrame(merged, "_low double, _high double")
    first, last = (F.floor(F.col(c) / F.lit(width)) for c in ("_low", "_high"))
    entries = entries.withColumn("_bin", F.explode(F.sequence(first, last)))
    entries = F.broadcast(entries) if len(merged) <= BROADCAST else entries
    value = F.col(column)
    return frame.join(entries, (F.floor(value / F.lit(width)) == F.col("_bin")) & value.between(F.col("_low"), F.col("_high")), "left_semi")


def pk_names(handle: Handle) -> tuple[str, ...]:
    return tuple(handle.data.peak_variables()) if "mz" not in handle.names else ()


def _replay(data: Dataset, log: tuple) -> Handle:
    out = data.spectra()
    for name, args, *more in log:
        out = getattr(out, name)(*args, **(more[0] if more else {}))
    return out
