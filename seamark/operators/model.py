"""One call from samples to indices: the closed-form model with yearly intercepts (E1, E5, E14-E16)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions import links
from seamark.operators import diagnostics, indices, sampling, spatial
from seamark.operators.estimate import Settings, simulate


def pool_rare(metadata: DataFrame, least: int) -> DataFrame:
    """c, map_id: categories with fewer than least positive samples share one parameter, the others have their own."""
    seen = metadata.groupBy("c").agg(F.sum("num_nonzero").alias("n"))
    rare = seen.agg(F.min(F.when(F.col("n") < least, F.col("c"))).alias("rare"))
    return seen.join(F.broadcast(rare)).select("c", F.when(F.col("n") < least, F.col("rare")).otherwise(F.col("c")).alias("map_id"))


def intercept_map(metadata: DataFrame) -> DataFrame:
    """c, t, beta1_id, beta2_id: numbers of estimated intercepts; null where a category and step cannot tell one, which is then held."""
    can1 = (F.col("num_notna") > 0) & (F.col("prop_nonzero") > 0) & (F.col("prop_nonzero") < 1)
    can2 = F.col("num_nonzero") > 0
    key = F.concat_ws("_", "c", "t")
    return metadata.select("c", "t", F.when(can1, key).alias("beta1_id"), F.when(can2, key).alias("beta2_id"))


def units(response: str = "kg", effort: str = "km^2", area: str = "km^2") -> dict[str, str]:
    """What results are measured in: density in response over effort, indices in that times area."""
    return {"density": f"{response} / {effort}", "index": response if effort == area else f"{response} / {effort} * {area}", "centre_of_gravity": "km", "effective_area": area}


@dataclass
class IndexModel:
    """A fitted model: intercepts by category and time, and the cells that it predicts on.

    obs: c, t, a, b; cells: g, e_km, n_km; cell_area: g, l, area.
    """

    obs: DataFrame
    cells: DataFrame
    cell_area: DataFrame
    settings: Settings = field(default_factory=Settings)
    metadata: DataFrame | None = None
    beta: DataFrame | None = None

    def fit(self) -> IndexModel:
        """Intercepts in closed form, from one aggregate over the samples."""
        self.metadata = sampling.encounter_metadata(self.obs)
        self.beta = sampling.exact_intercepts(self.metadata)
        return self

    def density(self) -> DataFrame:
        """g, c, t, r1, r2, d on every cell with area; unsampled steps are 0 or null, as settings say."""
        beta = self.beta.withColumns({"r1": links.inv_logit(F.col("beta1")), "r2": F.exp("beta2")}).withColumn("d", F.col("r1") * F.col("r2"))
        some = self.cell_area.where("area > 0").select("g").distinct()
        rows = some.join(F.broadcast(beta.select("c", "t", "r1", "r2", "d")))  # categories times steps
        return sampling.mask_unsampled(rows, self.metadata, "d", self.settings.zero_non_encounters)

    def index(self) -> DataFrame:
        """c, t, l, index.  Density is the same on all cells, so areas are summed before they meet it."""
        d = sampling.mask_unsampled(self.beta.select("c", "t", (links.inv_logit(F.col("beta1")) * F.exp("beta2")).alias("d")), self.metadata, "d", self.settings.zero_non_encounters)
        area = self.cell_area.groupBy("l").agg(F.sum("area").alias("area"))
        return d.join(F.broadcast(area)).select("c", "t", "l", (F.col("d") * F.col("area")).alias("index"))

    def predict(self, new: DataFrame) -> DataFrame:
        """new (c, t, a) with r1, r2 and expected response; nothing is fitted again."""
        rows = new.join(F.broadcast(self.beta), ["c", "t"], "left")
        return rows.withColumns({"r1": links.inv_logit(F.col("beta1")), "r2": F.col("a") * F.exp("beta2")}).withColumn("expected", F.col("r1") * F.col("r2")).drop("beta1", "beta2")

    def residuals(self, n_replicates: int = 100, sigma: float = 1.0, seed: int = 1) -> DataFrame:
        """i and its PIT residual u, from replicates that a hash of row and seed draws; obs needs a key i."""
        fitted = self.predict(self.obs.where("b IS NOT NULL")).where("r1 IS NOT NULL")
        bounds = diagnostics.pit_bounds(fitted, simulate(fitted, n_replicates, sigma, seed))
        return diagnostics.pit_residual(bounds, seed)

    def summary(self, what: str = "index", names: list[str] | None = None) -> DataFrame:
        """Labelled tables: index, density with coordinates, estimates."""
        if what == "index":
            return indices.index_table(self.index(), names or [], units()["index"]) if names else self.index()
        if what == "density":
            return self.density().join(self.cells.select("g", "e_km", "n_km"), "g")
        if what == "estimates":
            return self.beta.unpivot(["c", "t"], ["beta1", "beta2"], "name", "value").join(self.metadata.select("c", "t", "num_total"), ["c", "t"])
        raise ValueError(f"no summary of {what!r}")

    def at(self, places: DataFrame) -> DataFrame:
        """places (e_km, n_km) with the cell that is nearest to each, for densities elsewhere."""
        return spatial.nearest(places, self.cells.select("g", "e_km", "n_km"), "g")
