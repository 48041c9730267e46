"""The published tables: internal rows turned into named columns in micrometres and seconds. Each is one projection, with the aggregates it needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Units:
    """Micrometres a pixel, frames a second, and frames cut from the start of every trace."""

    um: float = 0.325
    rate: float = 1.0
    cut: int = 100

    def seconds(self, frame, shifted: bool = False):
        return F.round((frame + (self.cut if shifted else 0)) / self.rate, 1)

    def length(self, pixels):
        return F.round(pixels * self.um, 2)

    def speed(self, pixels_a_frame):
        return F.round(pixels_a_frame * self.um * self.rate, 2)


def peaks_table(p: DataFrame, u: Units = Units()) -> DataFrame:
    """The 24 columns of a peak. Needs peak_id, cell, event, base_on, base_off, on, off, frame, height, prominence, in_event, origin_type."""
    c = F.col
    rise, decay = c("frame") - c("on"), c("off") - c("frame")
    columns = {
        "Peak ID": c("peak_id"), "Cell ID": c("cell"), "Event ID": c("event"),
        "Baseline onset time (s)": u.seconds(c("base_on"), True), "Baseline offset time (s)": u.seconds(c("base_off"), True), "Baseline duration (s)": u.seconds(c("base_off") - c("base_on")),
        "FHW onset time (s)": u.seconds(c("on"), True), "FHW offset time (s)": u.seconds(c("off"), True), "FHW duration (s)": u.seconds(c("off") - c("on")),
        "Peak time (s)": u.seconds(c("frame")), "Onset time (s)": u.seconds(c("on")), "Offset time (s)": u.seconds(c("off")), "Duration (s)": u.seconds(c("off") - c("on")), "Event reference time (s)": u.seconds(c("frame")),
        "Height (noise std units)": F.round("height", 1), "Prominence (noise std units)": F.round("prominence", 1), "FHW height (noise std units)": F.round(c("height") - c("prominence") / 2, 1),
        "Baseline rise time (s)": u.seconds(c("frame") - c("base_on")), "Baseline decay time (s)": u.seconds(c("base_off") - c("frame")), "FHW rise time (s)": u.seconds(rise), "FHW decay time (s)": u.seconds(decay),
        "FHW symmetry score": F.when(rise + decay > 0, F.round(1 - F.abs(rise - decay) / (rise + decay), 3)), "In event": c("in_event"), "Origin type": c("origin_type"),
    }
    return p.select([v.alias(k) for k, v in columns.items()])


def compact_json(values):
    """A list of whole numbers as JSON without blanks."""
    return F.concat(F.lit("["), F.array_join(F.array_sort(values), ","), F.lit("]"))


def cells_table(k: DataFrame, u: Units = Units()) -> DataFrame:
    """The 15 columns of a cell. Needs cell, x, y, n_peaks, n_global, n_early, early_events, n_sequential, n_origin, n_individual, frequency, periodicity, neighbours."""
    c = F.col
    columns = {
        "Cell ID": c("cell"), "Centroid X coordinate (um)": u.length(c("x")), "Centroid Y coordinate (um)": u.length(c("y")), "Number of peaks": c("n_peaks"), "Is active": c("n_peaks") > 0,
        "Occurrences in global events": c("n_global"), "Occurrences in global events as early peaker": c("n_early"), "Early peaker event IDs": compact_json(c("early_events")),
        "Occurrences in sequential events": c("n_sequential"), "Occurrences in sequential events as origin": c("n_origin"), "Occurrences in individual events": c("n_individual"),
        "Peak frequency (Hz)": F.round(c("frequency") * u.rate, 6), "Periodicity score": F.round("periodicity", 4), "Neighbor count": F.size("neighbours"), "Neighbors (labels)": compact_json(c("neighbours")),
    }
    return k.select([v.alias(n) for n, v in columns.items()])


#: Columns of an event and the unit each takes: s seconds, t shifted seconds, v speed, n as it is, 2 two digits. A kind that lacks one has null.
EVENT = {
    "Event ID": ("event", "n"), "Event type": ("kind", "n"), "Event onset time (s)": ("onset", "t"), "Event offset time (s)": ("last", "t"), "Event duration (s)": ("duration", "s"), "Event peak time (s)": ("peak", "t"),
    "Number of cells involved": ("n_cells", "n"), "Propagation direction vector": ("direction", "n"), "Propagation speed (um/s)": ("speed", "v"), "Growth curve mean": ("growth_mean", "2"), "Growth curve std": ("growth_std", "2"),
    "Time to 50% (s)": ("half", "s"), "Normalized peak rate at 50% (% of peaks/s)": ("half_rate", "1"), "DAG number of nodes": ("nodes", "n"), "DAG number of edges": ("edges", "n"), "DAG number of roots": ("roots", "n"),
    "DAG depth": ("depth", "n"), "DAG width": ("width", "n"), "DAG average out degree": ("out_degree", "2"), "DAG average path length": ("path", "2"), "Average communication speed (um/s)": ("com_speed", "v"),
    "Standard deviation communication speed (um/s)": ("com_speed_std", "v"), "Average communication time (s)": ("com_time", "2"), "Standard deviation communication time (s)": ("com_time_std", "2"),
    "Elongation score": ("elongation", "2"), "Radiality score": ("radiality", "2"), "Compactness score": ("compactness", "2"),
}


def events_table(e: DataFrame, u: Units = Units()) -> DataFrame:
    """The 27 columns of an event of either kind; what a kind does not have is null."""
    held, out = set(e.columns), []
    for name, (source, unit) in EVENT.items():
        value = F.col(source) if source in held else F.lit(None).cast("double")
        if unit in "ts":
            value = u.seconds(value, unit == "t")
        elif unit == "v":
            value = u.speed(value)
        elif unit in "12":
            value = F.round(value, int(unit))
        out.append(value.alias(name))
    return e.select(out)


def communications_table(m: DataFrame, u: Units = Units()) -> DataFrame:
    """The 13 columns of a communication. Needs id, event, origin_cell, origin_peak, cause_cell, cause_peak, start, end, distance, time_phase, recruitment_phase."""
    c = F.col
    lag = c("end") - c("start")
    columns = {
        "Communication ID": c("id"), "Event ID": c("event"), "Origin cell ID": c("origin_cell"), "Origin cell peak ID": c("origin_peak"), "Cause cell ID": c("cause_cell"), "Cause cell peak ID": c("cause_peak"),
        "Start time (s)": u.seconds(c("start")), "End time (s)": u.seconds(c("end")), "Duration (s)": u.seconds(lag), "Distance (um)": u.length(c("distance")), "Speed (um/s)": u.speed(c("distance") / F.greatest(lag, F.lit(1))),
        "Event time phase (fraction of event duration)": F.round("time_phase", 2), "Event recruitment phase (fraction of involved cells)": F.round("recruitment_phase", 2),
    }
    return m.select([v.alias(n) for n, v in columns.items()])


def experiments_table(sequences: DataFrame) -> DataFrame:
    """Sequences with ``dataset``, their date, sequence, type and condition joined by underscores; missing parts are left out."""
    return sequences.withColumn("dataset", F.concat_ws("_", "date", "image_sequence", "experiment_type", "condition"))


def merge(tables: dict[str, DataFrame | None], experiments: DataFrame) -> DataFrame:
    """One table of all datasets, each row with its experiment's columns. Datasets without a table are left out; the experiments are few and sent to all tasks."""
    out = None
    for name, rows in tables.items():
        if rows is not None:
            part = rows.withColumn("dataset", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset has a table")
    return out.join(F.broadcast(experiments), "dataset", "left")
