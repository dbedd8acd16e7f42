"""The engine object: questions in, plans, stage events and results out."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import MODES, SETTINGS, Settings
from .operators import detect, interpret, places, raster, report, scenes, signatures, study
from .scratch import Scratch, saved
from .sources import archive as archives
from .sources import files
from .sources.archive import Archive, Unreachable

#: (title, question, icon, note)
EXAMPLES = (
    ("City growth", "Where has built-up land grown around Hyderabad between 2018 and 2024?", "building", "A city that spreads over its rim"),
    ("Forest loss", "Show forest cover loss in Wayanad since 2019", "tree", "Clearings in dense forest"),
    ("Shrinking lake", "Has Sambhar become smaller over the last 6 years?", "waves", "A salt lake with dry years"),
    ("Flood", "Which land was flooded in the Sundarbans between 2019 and 2021?", "droplet", "A delta under cyclones"),
    ("Regreening", "Did vegetation increase around Araku in the past 5 years?", "sprout", "A valley of plantations"),
    ("Fire", "Burned area near Aralam since 2020", "flame", "Dry slopes beside a reserve"),
)
STEPS = ("interpret", "locate", "search", "load", "quality", "detect", "filter", "render", "explain", "complete")


class StageError(Exception):
    """Ends an analysis; its text is the message of the last event."""


@dataclass
class Request:
    """A question and what its asker sets besides: a place's name, both years, a box (w, s, e, n in degrees), pixels along the grid's long side, a cloud limit in percent."""

    question: str
    place: str | None = None
    start: int | None = None
    end: int | None = None
    bbox: tuple[float, float, float, float] | None = None
    grid: int | None = None
    max_cloud: float | None = None


def examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXAMPLES), "title string, query string, icon string, note string")


class Engine:
    """Analyses of an archive; `store` is the folder of the signature store, or None.

    `analyze` yields stage events and leaves its tables in `last`; they stay until the next analysis of the same engine.
    """

    def __init__(self, spark: SparkSession, archive: Archive | str, store: str | None = None, today: dt.date | None = None, settings: Settings = SETTINGS):
        self.spark, self.archive, self.store, self.settings = spark, archive, store, settings
        self.today = today or dt.date.today()
        self.last: dict = {}
        self._own = Scratch()

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version, "modes": list(MODES), "date": self.today.isoformat()}

    def examples(self) -> DataFrame:
        return examples(self.spark)

    def interpret(self, question: str, place: str | None = None, start: int | None = None, end: int | None = None) -> dict:
        """The plan of a question, without any imagery."""
        rows = self.spark.createDataFrame([(question,)], "text string")
        plan = interpret.interpret(rows, self.today, "text", place, (start, end) if start and end else None, not (question or "").isascii())
        return plan.first().asDict(recursive=True)

    def pool(self, exclude: str | None = None) -> DataFrame:
        """The signatures that come with the package and those of the store, without one key."""
        pool = signatures.archetypes(self.spark)
        if self.store:
            pool = pool.unionByName(files.read_store(self.spark, self.store).where(~F.col("key").eqNullSafe(F.lit(exclude))))
        return pool

    def similar(self, k: int = 4) -> DataFrame:
        """The k records most like the last analysed area, never itself."""
        if not self.last:
            raise StageError("No analysis has been run.")
        return signatures.matches(F.array(*(F.lit(x) for x in self.last["signature"])), self.pool(self.last["key"]), k)

    def report(self) -> DataFrame:
        """(aoi, report) of the last analysis."""
        if not self.last:
            raise StageError("No analysis has been run.")
        return self.last["report"]

    # ---- stages -----------------------------------------------------------------------------------------------------------------------------

    def _locate(self, archive: Archive, ask: Request, plan: dict) -> dict:
        """The place, its box, its grid (a detect.Frame) and notes."""
        notes: list[str] = []
        if ask.bbox:
            found = self.spark.range(1).select(places.clamp_box(*(F.lit(float(x)) for x in ask.bbox)).alias("box")).first()
            if len(ask.bbox) != 4 or found.box is None:
                raise StageError("A box has four finite numbers: west, south, east and north.")
            place = {"label": plan["place"] or "Selected area", "box": tuple(found.box), "source": "box"}
        else:
            if not plan["place"]:
                raise StageError("The question names no place; add one, such as “near Hyderabad”.")
            names = self.spark.createDataFrame([(plan["place"],)], "query string")
            found = files.geocode(names, archive.answers).first()
            if found is None or found.box is None:
                raise StageError(f"“{plan['place']}” was not found; try a larger town or district nearby.")
            place = {"label": found.label, "box": tuple(found.box), "source": found.source, "lon": found.lon, "lat": found.lat}
            place |= self._window(archive, plan, names, notes)
        w, s, e, n = place["box"]
        sides = [F.lit(x) for x in place["box"]]
        target = places.grid_target(*sides, F.lit(ask.grid).cast("int"), self.settings)
        size = self.spark.range(1).select(places.grid_size(*sides, target).alias("g"), places.box_km(*sides).alias("km"))
        size = size.select("g", "km", places.pixel_ha(*sides, F.col("g.width"), F.col("g.height")).alias("ha")).first()
        if size.g is None:
            raise StageError("No grid fits an area without width or height.")
        if max(e - w, n - s) >= self.settings.large_span:
            notes.append("The area is very large, so its pixels are coarse; a district shows more.")
        frame = detect.Frame(size.g.height, size.g.width, size.ha, place["box"])
        return {"place": place, "frame": frame, "km": size.km.asDict(), "notes": notes}

    def _window(self, archive: Archive, plan: dict, names: DataFrame, notes: list[str]) -> dict:
        """The study window of a country-sized place, as changes to its place; nothing for others.  A country that cannot be reduced is too large."""
        name = F.lower(F.trim("name"))
        own = archive.boundaries.where(name == plan["place"].strip().lower()).limit(1)
        region = own.select("name", *"wsen").first()
        if region is None or region.w is None or max(abs(region.e - region.w), abs(region.n - region.s)) < study.COUNTRY_SPAN:
            return {}
        try:
            edges = files.boundary_edges(own)
            window = study.study_windows(own.select("name", *"wsen"), edges, archive.dem, "water" if plan["index"] == "MNDWI" else "any").first()
        except Exception as e:
            raise StageError("A whole country is too large; name a province, a district or a town.") from e
        half = study.WINDOW / 2
        box = tuple(round(x, 6) for x in (window.lon - half, window.lat - half, window.lon + half, window.lat + half))
        if window.method == "centroid-fallback":
            notes.append("No spot inside the boundary could be found; the middle of the region is used.")
            return {"study_area": window.asDict(), "reduced": True}
        if window.coverage is not None:
            notes.append(f"{window.coverage:.0%} of the window lies inside the boundary.")
        height = "" if window.elevation is None else f", {window.elevation:.0f} m high"
        spot = {"lowest-land-in-country": "on its lowest land", "lowest-elevation-in-country": "on its lowest ground", "median-elevation-in-country": "on ground of middle height"}.get(window.method, "in its middle")
        notes.append(f"{region.name} is as large as a country; a window of {study.WINDOW:.1f}° {spot}{height} stands for it.")
        return {"box": box, "lon": window.lon, "lat": window.lat, "study_area": window.asDict(), "reduced": True}

    def _search(self, archive: Archive, ask: Request, plan: dict, label: str, box: tuple) -> dict:
        """The chosen scenes with their companions, as `wanted` (k, ord, scene_id) and `epochs`; notes and rejected years."""
        start, end = plan["start_year"], plan["end_year"]
        found = saved(files.found_scenes(archive.features, start, end, self.settings, ask.max_cloud, box).drop("assets"), "scenes")
        total = found.count()
        if not total:
            raise StageError(f"No fitting images of {label} from {start} to {end}; try a longer period or allow more cloud.")
        chosen = saved(scenes.best_per_year(found, self.settings), "chosen")
        mates = scenes.companions(found, chosen).collect()
        rows = sorted(chosen.select("id", "date", "year", "cloud", "mgrs").collect(), key=lambda r: (r["date"], r["id"]))
        if len(rows) < 2:
            raise StageError(f"Only {len(rows)} date of {label} is clear enough and two are needed; try a longer period or allow more cloud.")
        notes = scenes.selection_notes(found, chosen, self.settings).first()["notes"]
        most = self.settings.max_epochs
        if len(rows) > most:
            notes.append(f"Of {len(rows)} dates {most} are used, the first and the last among them.")
            rows = [*rows[: most - 1], rows[-1]]
        wanted = [(k, 0, r["id"]) for k, r in enumerate(rows)]
        at = {r["id"]: k for k, r in enumerate(rows)}
        wanted += [(at[m.chosen_id], m.ord, m.companion_id) for m in mates if m.chosen_id in at]
        epochs = [(1, k, r["id"], r["date"], r["year"], r["cloud"]) for k, r in enumerate(rows)]
        return {
            "total": total, "notes": notes, "rejected": [r.asDict() for r in scenes.rejected(chosen, start, end).orderBy("year").collect()],
            "wanted": self.spark.createDataFrame(wanted, "k int, ord int, scene_id string"),
            "epochs": self.spark.createDataFrame(epochs, "aoi long, k int, scene_id string, date date, year int, cloud double"),
        }

    def _load(self, archive: Archive, found: dict, frame: detect.Frame, label: str) -> tuple[DataFrame, DataFrame, list[dict]]:
        """Pixels and epochs of the usable dates, numbered anew from 0, and those that were dropped."""
        cells = saved(archives.load_epochs(archive, found["wanted"], frame.box, frame.height, frame.width), "cells")
        seen = saved(found["epochs"].join(archives.epoch_quality(cells), "k"), "epochs")
        readable = seen.where("valid_fraction > 0").count()
        if readable < 2:
            raise StageError(f"Only {readable} date of {label} could be read and two are needed; try a longer period or allow more cloud.")
        usable = detect.usable_epochs(seen, self.settings).select("k")
        number = F.expr("CAST(row_number() OVER (PARTITION BY aoi ORDER BY k) - 1 AS INT)")
        epochs = saved(seen.join(usable, "k", "left_semi").withColumn("n", number), "epochs")
        dropped = [r.asDict() for r in seen.join(usable, "k", "left_anti").select("date", "valid_fraction").orderBy("date").collect()]
        pixels = cells.join(F.broadcast(epochs.select("aoi", "k", "n", "year")), "k").drop("k").withColumnRenamed("n", "k")
        return saved(pixels, "pixels"), epochs.drop("k").withColumnRenamed("n", "k"), dropped

    def _measure(self, pixels: DataFrame, epochs: DataFrame, mode: str, frame: detect.Frame) -> dict:
        """Candidates, labels, shift, quality, clusters, timeline and stats of one mode."""
        both = saved(detect.pair(pixels), "pair")
        marked = saved(detect.candidates(pixels, mode, self.settings, both), "marked")
        if not marked.take(1):
            raise StageError("The first and the last image share no clear ground; try a longer period or allow more cloud.")
        labels = saved(detect.labelled(marked, frame, self.settings), "labels")
        shift = saved(detect.registration(marked, mode, frame), "shift")
        clusters = saved(detect.clusters(pixels, mode, frame, self.settings, shift, (marked, labels)), "clusters")
        quality = detect.quality_counts(pixels, mode, frame, self.settings, (marked, labels), both)
        summary = saved(report.stats(clusters, quality, epochs, frame.pixel_ha, shift, self.settings).join(shift.select("aoi", "sharpness"), "aoi"), "stats")
        found = report.findings(summary, mode, self.settings)
        return {"both": both, "marked": marked, "labels": labels, "shift": shift, "clusters": clusters, "stats": summary, "findings": saved(found, "findings"), "timeline": saved(detect.timeline(pixels, mode, frame, self.settings, (marked, labels)), "timeline")}

    def _render(self, pixels: DataFrame, got: dict, mode: str, frame: detect.Frame) -> DataFrame:
        """(name, k, png): views before and after, change over the last image, mask, heat, classes, and a small one of each date; made when they are read."""
        direction, size = MODES[mode][2], (frame.height, frame.width)
        shades = saved(raster.stretched(pixels.select("aoi", "k", "r", "c", "red", "green", "blue", "valid"), group=("aoi", "k")), "shades")
        ends = pixels.select(F.min("k"), F.max("k")).first()
        of = lambda rows, k: rows.where(F.col("k") == k)
        shift = got["marked"].groupBy("aoi").agg(F.first("shift").alias("shift"))
        index = detect.index(detect.mode_index(mode), "_a") - detect.index(detect.mode_index(mode), "_b")
        moved = got["both"].join(shift, "aoi").withColumn("delta", index - F.col("shift"))
        views = {
            "before": raster.rgb_png(of(shades, ends[0]), *size), "after": raster.rgb_png(of(shades, ends[1]), *size),
            "overlay": raster.rgb_png(raster.overlay(of(shades, ends[1]), got["labels"], direction), *size),
            "mask": raster.masks_png(got["both"], got["labels"], direction, *size), "heatmap": raster.heat_png(raster.heat_index(moved, "delta", direction), *size),
            "scl_before": raster.class_png(of(pixels, ends[0]), *size), "scl_after": raster.class_png(of(pixels, ends[1]), *size),
        }
        out = raster.thumb_png(shades, *size).select(F.lit("thumb").alias("name"), "k", "png")
        for name, image in views.items():
            out = out.unionByName(image.select(F.lit(name).alias("name"), F.lit(None).cast("int").alias("k"), "png"))
        return out

    def _explain(self, ask: Request, plan: dict, where: dict, epochs: DataFrame, got: dict, frame: detect.Frame) -> dict:
        """Narrative, report, signature and matches."""
        mode, label = plan["mode"], where["place"]["label"]
        detailed = got["clusters"].where(F.col("id") <= self.settings.detail_cap)
        bias = report.spatial_bias(detailed.select("aoi", F.col("centre_lon").alias("lon"), F.col("centre_lat").alias("lat"), "area_ha"))
        story = saved(report.narrative(got["stats"], bias, report.onset_span(detailed), got["findings"], mode, label, plan["proximity"]), "story")
        text = saved(report.markdown(ask.question, story, got["stats"], got["clusters"], epochs), "report")
        vector = signatures.describe(got["both"], got["labels"], frame.pixel_ha, self.settings).first()["vector"]
        w, s, e, n = where["place"]["box"]
        period = f"{plan['start_year']}-{plan['end_year']}"
        key = f"{label}|{period}|{mode}"
        if self.store:
            old = files.read_store(self.spark, self.store)
            seq = (old.agg(F.max("seq")).first()[0] or 0) + 1
            head = story.first()["headline"]
            record = (key, seq, label, (w + e) / 2, (s + n) / 2, period, mode, vector, head, got["stats"].first()["changed_area_ha"])
            files.write_store(signatures.upsert(old, self.spark.createDataFrame([record], files.STORE)), self.store)
        return {"narrative": story, "report": text, "signature": vector, "key": key}

    # ---- the whole --------------------------------------------------------------------------------------------------------------------------

    def analyze(self, question: str | Request, start: int | None = None, end: int | None = None, place: str | None = None, bbox=None, grid: int | None = None, max_cloud: float | None = None) -> Iterator[dict]:
        """Events (step, status, message, t and more) of one analysis, in order; an error is the last event.  Afterwards `last` holds its tables."""
        ask = question if isinstance(question, Request) else Request(question, place, start, end, bbox, grid, max_cloud)
        self._own.close()
        self._own, self.last = Scratch(), {}
        t0 = time.monotonic()
        step = STEPS[0]

        def event(status: str, message: str = "", **more) -> dict:
            return {"step": step, "status": status, "message": message, "t": round(time.monotonic() - t0, 3), **more}

        def run(stage, *args):
            with self._own:
                return stage(*args)

        rows = lambda df: [json.loads(x) for x in files.lines(report.display(df))]
        try:
            yield event("running")
            plan = self.interpret(ask.question, ask.place, ask.start, ask.end)
            mode = plan["mode"]
            yield event("done", f"{plan['label']}, {plan['start_year']} to {plan['end_year']}", plan=plan)
            step = "locate"
            yield event("running")
            try:
                archive = self.archive if isinstance(self.archive, Archive) else Archive.open(self.spark, self.archive)
            except Unreachable as e:
                step = "search"
                raise StageError("The catalog cannot be reached.") from e
            where = run(self._locate, archive, ask, plan)
            frame, label = where["frame"], where["place"]["label"]
            km = where["km"]
            yield event("done", f"{label}, about {km['wide']:.0f} by {km['high']:.0f} km", place=where["place"], grid={"bounds": list(frame.box), "width": frame.width, "height": frame.height, "crs": "EPSG:4326"}, area_km2=km["area"], notes=where["notes"])
            step = "search"
            yield event("running")
            found = run(self._search, archive, ask, plan, label, frame.box)
            yield event("done", f"{found['epochs'].count()} dates of {found['total']} scenes", scenes=rows(found["epochs"]), notes=found["notes"], rejected=found["rejected"], total_candidates=found["total"])
            step = "load"
            yield event("running")
            pixels, epochs, dropped = run(self._load, archive, found, frame, label)
            yield event("done", f"{epochs.count()} images on {frame.width} by {frame.height} pixels", epochs=rows(epochs), dropped=dropped)
            step = "quality"
            yield event("running")
            got = run(self._measure, pixels, epochs, mode, frame)
            summary = rows(got["stats"])[0]
            yield event("done", f"In line to {summary['shift_px']:.1f} pixels; {summary['valid_fraction']:.0%} of the area is usable", quality=summary | {"epochs": rows(epochs)})
            step = "detect"
            yield event("running")
            yield event("done", f"{summary['cluster_count']} clusters, {summary['changed_area_ha']:.1f} ha" if summary["cluster_count"] else "No change passed the tests", stats=summary)
            step = "filter"
            yield event("running")
            notes = got["findings"].first()
            yield event("done", "" if not summary.get("noise_rejection") else f"{summary['noise_rejection']:.0%} of the hits were noise", evidence=notes["evidence"], caveats=notes["caveats"])
            step = "render"
            yield event("running")
            images = run(self._render, pixels, got, mode, frame)
            yield event("done", "Views are ready to be read")
            step = "explain"
            yield event("running")
            told = run(self._explain, ask, plan, where, epochs, got, frame)
            self.last = {
                **told, "stats": got["stats"], "epochs": epochs, "timeline": got["timeline"], "images": images, "labels": got["labels"], "marked": got["marked"], "pixels": pixels, "frame": frame,
                "clusters": report.cluster_findings(got["clusters"], mode, summary["epoch_count"], got["shift"], self.settings).where(F.col("id") <= report.RESPONSE_CLUSTERS),
            }
            yield event(
                "done", "Analysis complete", narrative=json.loads(next(files.lines(told["narrative"]))), clusters=rows(self.last["clusters"].orderBy("id")), timeline=rows(got["timeline"].orderBy("k")),
                similar=[r.asDict() for r in self.similar().collect()], confidence=summary["confidence"], confidence_band=summary["band"],
            )
            step = "complete"
            yield event("done", f"Done in {time.monotonic() - t0:.1f} s", stats=[summary])
        except StageError as e:
            yield event("error", str(e))
        except Exception as e:
            step = "error"
            yield event("error", f"The analysis failed: {type(e).__name__}: {str(e)[:400]}")

    def image(self, name: str, k: int | None = None) -> str | None:
        """One view of the last analysis as a data URI: before, after, overlay, mask, heatmap, scl_before, scl_after, or thumb with the number of its date; None if there is none."""
        if not self.last:
            raise StageError("No analysis has been run.")
        row = self.last["images"].where((F.col("name") == name) & F.col("k").eqNullSafe(F.lit(k).cast("int"))).select(raster.data_uri(F.col("png")).alias("uri")).first()
        return row and row["uri"]

    def thumb_of_year(self, year: int) -> str | None:
        """The small view of the date in that year."""
        row = self.last["epochs"].where(F.col("year") == year).select("k").first() if self.last else None
        return row and self.image("thumb", row["k"])
