"""The steps of tracking as one object that knows how far it has come."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import inside_border
from ..operators import hierarchy, lineage, linking, matching, segmentation, solving
from ..operators.pixels import paint
from ..operators.tracks import drift
from ..sources.chunks import write_chunks
from ..sources.durable import durable
from ..sources.formats import tracks_layer, write_tracks
from .config import Config


class Status(IntEnum):
    NOT_COMPUTED = 0
    SEGMENTED = 1
    LINKED = 2
    SOLVED = 3


class Tracker:
    """Segments, links and solves; every table is written once, and a later step needs the ones before it."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config, self.status = spark, config or Config(), Status.NOT_COMPUTED
        self.nodes: DataFrame | None = None
        self.overlaps: DataFrame | None = None
        self.links: DataFrame | None = None
        self.solution: DataFrame | None = None

    def _need(self, status: Status) -> None:
        if self.status < status:
            raise ValueError(f"this needs status {status.name}; it is {self.status.name}")

    def segment(self, pixels: DataFrame, height: int, width: int) -> Tracker:
        return self.use_nodes(segmentation.segment(pixels, height, width, self.config.segmentation))

    def use_nodes(self, nodes: DataFrame) -> Tracker:
        """Takes candidates that were found elsewhere, with hier_parent_id where they overlap."""
        self.nodes = durable(nodes)
        self.overlaps = durable(hierarchy.overlap_closure(self.nodes)) if "hier_parent_id" in nodes.columns else self.spark.createDataFrame([], "node_id bigint, ancestor_id bigint")
        self.status = Status.SEGMENTED
        return self

    def add_flow(self, field: DataFrame, shape: tuple[int, int], scale: tuple[float, float] = (1.0, 1.0)) -> Tracker:
        from ..operators.pixels import flow_shifts

        self._need(Status.SEGMENTED)
        self.nodes = durable(flow_shifts(self.nodes, field, shape, scale).drop("cy", "cx", "vy", "vx"))
        return self

    def link(self, **options) -> Tracker:
        """Links by boxes if nodes have a half extent h, and by masks if they have runs."""
        self._need(Status.SEGMENTED)
        c = self.config.linking
        if "h" in self.nodes.columns:
            if {"mean", "std"} <= set(self.nodes.columns):
                options = {"keep": linking.color_filter(c.z_score_threshold), **options}
            found = linking.knn_links(self.nodes, c.max_distance, c.max_neighbors, c.distance_weight, **options)
        else:
            pairs = linking.candidate_pairs(self.nodes.drop("runs"), c.max_distance).select(F.col("s.id").alias("a_id"), F.col("g.id").alias("b_id"), F.col("s.t").alias("t_source"), "dist")
            near = F.expr("row_number() over (partition by b_id order by dist, a_id)")
            pairs = pairs.withColumn("_n", near).where(F.col("_n") <= 2 * c.max_neighbors).drop("_n")
            weighed = segmentation.mask_iou(pairs, self.nodes).withColumn("weight", F.col("iou") - c.distance_weight * F.col("dist"))
            best = F.expr("row_number() over (partition by b_id order by weight desc, dist, a_id desc)")
            found = weighed.withColumn("_n", best).where(F.col("_n") <= c.max_neighbors).select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), "t_source", "dist", "weight")
        return self.add_links(found)

    def add_links(self, links: DataFrame) -> Tracker:
        self._need(Status.SEGMENTED)
        self.links = durable(links if self.links is None else linking.append_links(self.links, links))
        self.status = Status.LINKED
        return self

    def add_nodes_prob(self, probs: DataFrame) -> Tracker:
        self._need(Status.SEGMENTED)
        self.nodes = durable(matching.set_values(self.nodes, probs))
        return self

    def add_links_prob(self, probs: DataFrame) -> Tracker:
        self._need(Status.LINKED)
        self.links = durable(matching.set_link_weights(self.links, probs))
        return self

    def solve(self, shape: tuple[int, int] | None = None, **options) -> Tracker:
        """Selects nodes and links. With image_border_size, which needs the frames' shape (height, width), tracks may start
        and end at no cost within that border."""
        self._need(Status.LINKED)
        nodes, border = self.nodes, self.config.tracking.image_border_size
        if border is not None:
            if shape is None:
                raise ValueError("image_border_size needs the shape of the frames")
            inside = inside_border([F.col("y"), F.col("x")], list(shape), list(border)[-2:])
            nodes, options = nodes.withColumn("at_border", ~inside), {**options, "border": "at_border"}
        self.solution = durable(solving.solve(nodes, self.links, self.overlaps, self.config.tracking, **options))
        self.status = Status.SOLVED
        return self

    def match_to_ground_truth(self, truth: DataFrame, distance_weight: float = 0.0, optimize_config: bool = False) -> Tracker:
        """Gives nodes their gt_track_id from truth, pixels (t, y, x, label), 0 being background.

        Nodes of one frame and true objects are matched by the pixels that they share, less distance_weight times the distance
        of their centroids. What overlaps a matched node is blocked, all else is without overlap. With optimize_config the
        parameters that the matched nodes suggest are taken over.
        """
        self._need(Status.SEGMENTED)
        real = truth.where("label > 0").select("t", "y", "x", F.col("label").cast("bigint").alias("target_id"))
        centres = real.groupBy("t", "target_id").agg(F.avg("y").alias("_y"), F.avg("x").alias("_x"))
        shared = segmentation.mask_pixels(self.nodes).join(real, ["t", "y", "x"]).groupBy("t", F.col("id").alias("source_id"), "target_id").agg(F.count(F.lit(1)).alias("n"))
        shared = shared.join(centres, ["t", "target_id"]).join(self.nodes.select(F.col("id").alias("source_id"), "y", "x"), "source_id")
        far = F.sqrt((F.col("y") - F.col("_y")) ** 2 + (F.col("x") - F.col("_x")) ** 2)
        candidates = shared.select("t", "source_id", "target_id", (F.col("n") - distance_weight * far).alias("weight")).where("weight > 0")
        found = durable(solving.match_frames(candidates, self.overlaps)).withColumn("selected", F.lit(True))
        nodes = matching.blocked(matching.gt_matches(self.nodes.drop("gt_track_id"), found), self.overlaps)
        self.nodes = durable(nodes)
        if optimize_config:
            self._take_over(self.nodes.where("gt_track_id > 0"))
        return self

    def _take_over(self, matched: DataFrame) -> None:
        above = hierarchy.parent_frontier(self.nodes, "frontier") if "frontier" in self.nodes.columns else self.nodes.withColumn("parent_frontier", F.lit(0.0))
        own = above.join(matched.select("id"), "id", "left_semi")
        ways = drift(matched.select(F.col("gt_track_id").alias("track_id"), "t", "z", "y", "x"))
        row = matching.optimized_config(own, ways).head()
        if row is None or row["min_area"] is None:
            raise ValueError("no node was matched")
        self.config.segmentation.min_area, self.config.segmentation.max_area = int(row["min_area"]), int(row["max_area"] + 1)
        self.config.segmentation.min_frontier, self.config.linking.max_distance = float(row["min_frontier"]), float(row["max_distance"])

    def get_nodes_features(self, pixels: DataFrame | None = None, measures: dict[str, Column] | None = None) -> DataFrame:
        """A row a node: id, t, area, frontier and height if there are any, the sides of its mask's box, and for pixels (t, y, x,
        intensity) the mean, deviation, least and largest intensity under its mask, and the named measures, aggregates of
        y, x and the columns of pixels."""
        self._need(Status.SEGMENTED)
        own = segmentation.mask_pixels(self.nodes)
        found = {"box_height": F.max("y") - F.min("y") + 1, "box_width": F.max("x") - F.min("x") + 1}
        if pixels is not None:
            own = own.join(pixels, ["t", "y", "x"], "left")
            found |= {"intensity_mean": F.avg("intensity"), "intensity_std": F.stddev_pop("intensity"), "intensity_min": F.min("intensity"), "intensity_max": F.max("intensity")}
        found |= measures or {}
        made = own.groupBy("id").agg(*(c.alias(n) for n, c in found.items()))
        return self.nodes.select(*(c for c in ("id", "t", "area", "frontier", "height") if c in self.nodes.columns)).join(made, "id")

    def fit_nodes(self, features: DataFrame, columns: list[str], model=None):
        """A classifier of nodes as real ones or not, from their features (id and columns), of nodes that overlap with truth."""
        labels = self.nodes.where(F.col("gt_track_id") != matching.NO_OVERLAP).select("id", (F.col("gt_track_id") > 0).alias("label"))
        return matching.fit_classifier(features.join(labels, "id"), columns, "label", model or matching.LogisticClassifier())

    def predict_nodes(self, features: DataFrame, columns: list[str], model) -> Tracker:
        """Sets node_prob of all nodes that have features."""
        return self.add_nodes_prob(matching.predict(features, ["id"], columns, model).withColumnRenamed("prob", "node_prob"))

    def fit_links(self, features: DataFrame, columns: list[str], model=None, competing: bool = False):
        """A classifier of links as true ones or not, from the differences of their ends' features and their distance; with
        competing from the links of targets that have a true one only."""
        self._need(Status.LINKED)
        labelled = matching.link_labels(self.links, self.nodes)
        labelled = matching.competing_links(labelled) if competing else labelled
        rows = self._link_features(features, columns).join(labelled.select("source_id", "target_id", "gt"), ["source_id", "target_id"])
        return matching.fit_classifier(rows, [*columns, "dist"], "gt", model or matching.LogisticClassifier())

    def predict_links(self, features: DataFrame, columns: list[str], model) -> Tracker:
        """Sets the weights of all links."""
        rows = self._link_features(features, columns)
        return self.add_links_prob(matching.predict(rows, ["source_id", "target_id"], [*columns, "dist"], model).withColumnRenamed("prob", "weight"))

    def _link_features(self, features: DataFrame, columns: list[str]) -> DataFrame:
        placed = features.select("id", *columns).join(self.nodes.select("id", "z", "y", "x"), "id")
        return linking.link_features(self.links, placed, columns)

    def clear(self, what: str = "all") -> Tracker:
        """Forgets all, the links and what follows, the solution, or the ground truth ('truth')."""
        if what == "truth":
            self.nodes = self.nodes.drop("gt_track_id") if self.nodes is not None else None
            return self
        left = {"all": Status.NOT_COMPUTED, "links": Status.SEGMENTED, "solution": Status.LINKED}[what]
        if left < Status.SEGMENTED:
            self.nodes = self.overlaps = None
        if left < Status.LINKED:
            self.links = None
        self.solution = None
        self.status = min(self.status, left)
        return self

    def track(self, pixels: DataFrame, height: int, width: int, overwrite: str = "none") -> Tracker:
        """All steps; with overwrite 'links' or 'solution', only from there on, if the ones before are done."""
        if overwrite in ("links", "solution"):
            self.clear(overwrite)
        elif overwrite == "all" or self.status == Status.NOT_COMPUTED:
            self.clear("all").segment(pixels, height, width)
        if self.status < Status.LINKED:
            self.link()
        return self.solve() if self.status < Status.SOLVED else self

    def tracks(self, with_z: bool = True) -> DataFrame:
        self._need(Status.SOLVED)
        places = self.nodes.select("id", "z", "y", "x")
        labelled = lineage.add_track_ids(self.solution.select("id", "t", "parent_id"))
        return tracks_layer(labelled.join(places, "id"), with_z)

    def labels(self) -> DataFrame:
        """(t, y, x, label) of the pixels of the solution's nodes, painted with their tracks."""
        self._need(Status.SOLVED)
        tracked = lineage.add_track_ids(self.solution.select("id", "t", "parent_id")).select("id", "track_id")
        masks = segmentation.mask_pixels(self.nodes).join(tracked, "id").join(self.nodes.select("id", "area"), "id")
        # Of masks that share a pixel the smaller one lies on top.
        return paint(masks.select("t", "y", "x", F.col("track_id").alias("id"), (-F.col("area")).alias("paint_order")))

    def export_labels(self, path: str, shape: tuple[int, int, int], chunks: tuple[int, int, int] | None = None, overwrite: bool = False) -> None:
        """Writes labels() as a raster in chunks; frames without nodes are 0."""
        write_chunks(self.labels(), path, shape, chunks, overwrite=overwrite)

    def export(self, path: str, overwrite: bool = False) -> None:
        write_tracks(self.tracks(), path, overwrite)
