"""Offshore wind model: energy, cost, payback and carbon for many projects at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.functions.cleaning import not_nan
from siteglass.functions.text import amount_text

HOURS_PER_YEAR = 8760


@dataclass(frozen=True)
class Scenario:
    """Assumptions of one model run. Prices in pounds, costs in million pounds."""

    # The defaults.
    capacity_factor: float = 0.45
    turbine_rating: float = 15.0
    electricity_price: float = 70.0
    capex_per_mw: float = 3.0
    lifetime: int = 25
    grid_carbon_intensity: float = 0.20


DEFAULT_SCENARIO = Scenario()
SCENARIO_COLUMNS = tuple(field.name for field in fields(Scenario))

# Capacity factors of the sensitivity table.
SENSITIVITY_GRID = (0.35, 0.40, 0.45, 0.50, 0.55)

# Accepted range of each assumption.
SCENARIO_RANGES = {
    "capacity_factor": (0.20, 0.70),
    "turbine_rating": (5.0, 25.0),
    "electricity_price": (20.0, 200.0),
    "capex_per_mw": (1.0, 8.0),
    "lifetime": (10, 40),
    "grid_carbon_intensity": (0.0, 0.60),
}


def with_scenarios(df: DataFrame, scenarios: Sequence[Scenario] = (DEFAULT_SCENARIO,)) -> DataFrame:
    """Every project once per scenario, the assumptions as columns.

    The scenarios travel inside the plan as a constant array, so this is a
    row-local expansion, not a join. Assumptions kept per project in a table of
    their own are joined on a key instead; see ``with_offshore_figures``.
    """
    rows = [
        F.struct(*[F.lit(value).alias(name) for name, value in asdict(scenario).items()])
        for scenario in scenarios
    ]
    return df.select("*", F.inline(F.array(*rows)))


def _annual_energy() -> Column:
    return F.col("capacity_mw") * F.col("capacity_factor") * HOURS_PER_YEAR


def _quotient(amount: Column, by: Column) -> Column:
    return not_nan(F.try_divide(amount, by))


def with_offshore_figures(df: DataFrame) -> DataFrame:
    """Add the model's results to rows that hold a capacity and the assumptions."""
    energy, revenue = F.col("annual_energy_mwh"), F.col("annual_revenue")
    return (
        df.withColumns(
            {
                "annual_energy_mwh": _annual_energy(),
                "turbines": _quotient(F.col("capacity_mw"), F.col("turbine_rating")),
                "total_capex": F.col("capacity_mw") * F.col("capex_per_mw") * F.lit(1e6),
            }
        )
        .withColumns(
            {
                "annual_revenue": energy * F.col("electricity_price"),
                "annual_carbon_t": energy * F.col("grid_carbon_intensity"),
            }
        )
        .withColumns(
            {
                "simple_payback": _quotient(F.col("total_capex"), revenue),
                "lifetime_revenue": revenue * F.col("lifetime"),
                "lifetime_carbon_t": F.col("annual_carbon_t") * F.col("lifetime"),
            }
        )
    )


def offshore_model(df: DataFrame, scenarios: Sequence[Scenario] = (DEFAULT_SCENARIO,)) -> DataFrame:
    return with_offshore_figures(with_scenarios(df, scenarios))


def offshore_texts(model: DataFrame) -> DataFrame:
    """The model's results as display text."""
    texts = {
        "capacity_text": amount_text(F.col("capacity_mw"), 0, after=" MW"),
        "annual_energy_text": amount_text(F.col("annual_energy_mwh"), 0, after=" MWh/year"),
        "turbines_text": amount_text(F.col("turbines"), 1),
        "annual_revenue_text": amount_text(F.col("annual_revenue") / 1e6, 1, "£", "m/year"),
        "total_capex_text": amount_text(F.col("total_capex") / 1e9, 2, "£", "bn"),
        "simple_payback_text": amount_text(F.col("simple_payback"), 1, after=" years"),
        "lifetime_revenue_text": amount_text(F.col("lifetime_revenue") / 1e9, 2, "£", "bn"),
        "annual_carbon_text": amount_text(F.col("annual_carbon_t"), 0, after=" tonnes CO₂e/year"),
        "lifetime_carbon_text": amount_text(F.col("lifetime_carbon_t"), 0, after=" tonnes CO₂e"),
    }
    return model.select("ref_id", "site_name", *[text.alias(name) for name, text in texts.items()])


def offshore_sensitivity(
    df: DataFrame,
    scenario: Scenario = DEFAULT_SCENARIO,
    grid: Sequence[float] = SENSITIVITY_GRID,
) -> DataFrame:
    """Energy, revenue and payback of every project along a grid of capacity factors."""
    runs = offshore_model(df, [replace(scenario, capacity_factor=factor) for factor in grid])
    return runs.select(
        "ref_id",
        "site_name",
        "capacity_factor",
        "annual_energy_mwh",
        (F.col("annual_revenue") / 1e6).alias("annual_revenue_m"),
        "simple_payback",
    )


def check_scenarios(scenarios: DataFrame) -> DataFrame:
    """Add ``valid`` and the list of assumptions outside their range.

    A missing assumption counts as outside.
    """
    outside = [
        F.when(F.coalesce(F.col(name).between(low, high), F.lit(False)), F.lit(None)).otherwise(F.lit(name))
        for name, (low, high) in SCENARIO_RANGES.items()
    ]
    return scenarios.withColumn("out_of_range", F.concat_ws(",", *outside)).withColumn(
        "valid", F.col("out_of_range") == ""
    )
