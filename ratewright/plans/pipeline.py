"""The batch pipeline over loaded filings: tables of all stages, their summary and reports."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.models import counts
from ratewright.operators import detectability, influence, panel, peers, rates, render, sectors, stability
from ratewright.operators.expectations import Stage, topological
from ratewright.operators.screen import Bounds, screened
from ratewright.shared import cut
from ratewright.sources.results import rows_of, write_csv, write_json


#: Tables that reports and the summary show row by row, and the rows up to which they do.
REPORTED, REPORT_ROWS = {"quality_overall", "quality_by_year", "flag_prevalence"}, 1000


@dataclass(frozen=True)
class Config:
    """One set of parameters that every stage uses."""

    bounds: Bounds = field(default_factory=Bounds)
    least_group: int = 30
    naics_level: int = 3
    least_model_rows: int = 200
    most_industries: int = 30
    permutations: int = 200
    focus_year: int | None = None
    old_years: tuple[int, ...] = ()


#: What each stage reads and writes; `run` goes through them in an order that this allows.
LINEAGE = [
    Stage("screen", ("filings",), ("screened",)),
    Stage("quality", ("screened",), ("quality_overall", "quality_by_year", "quality_by_naics2", "flag_prevalence", "sensitivity_grid", "hours_concentration", "top50_high")),
    Stage("peers", ("screened",), ("peer_percentiles_by_year", "peer_percentiles_pooled", "size_band_effects", "zero_share_by_year")),
    Stage("metrics", ("screened",), ("metrics_by_year", "metrics_pooled")),
    Stage("models", ("screened",), ("count_fits", "count_selection", "covariate_fits")),
    Stage("stability", ("screened", "peer_percentiles_by_year"), ("band_stability", "group_persistence", "leave_one_year_out", "year_over_year")),
    Stage("panel", ("screened",), ("panel_coverage", "panel_transitions", "key_drift", "permutation_null")),
    Stage("influence", ("screened", "peer_percentiles_by_year"), ("exposure", "influence_ranking", "trend_reversals", "decomposition", "exclusions", "accounting")),
    Stage("sectors", ("screened",), ("wilson_by_sector", "sector_ex_top50", "detectability")),
]


def stage_tables(df: DataFrame, cfg: Config) -> dict[str, dict[str, Callable[[], DataFrame]]]:
    """Tables by stage, each built when asked for. df: screened filings."""
    table = lambda *by: peers.percentile_table(df, by, cfg.naics_level, cfg.least_group)
    flags = panel.flag_panel(df)
    loo = influence.leave_one_filing_out(df)
    fits = lambda: counts.fit_industries(df, least=cfg.least_model_rows, most=cfg.most_industries)

    return {
        "quality": {"quality_overall": lambda: rates.summarise(df), "quality_by_year": lambda: rates.summarise(df, "year_filing_for"), "quality_by_naics2": lambda: rates.summarise(df, "naics2"), "flag_prevalence": lambda: rates.flag_prevalence(df), "sensitivity_grid": lambda: rates.sensitivity_grid(df), "hours_concentration": lambda: rates.hours_concentration(df), "top50_high": lambda: sectors.top_high(df)},
        "peers": {"peer_percentiles_by_year": lambda: table("year_filing_for"), "peer_percentiles_pooled": lambda: table(), "size_band_effects": lambda: rates.size_effects(df), "zero_share_by_year": lambda: rates.zero_share(df, "year_filing_for")},
        "metrics": {"metrics_by_year": lambda: rates.rates(df, "year_filing_for"), "metrics_pooled": lambda: rates.rates(df)},
        "models": {"count_fits": fits, "count_selection": lambda: counts.selection(fits()), "covariate_fits": lambda: counts.fit_covariates(df, least=cfg.least_model_rows, most=cfg.most_industries)},
        "stability": {"band_stability": lambda: stability.band_stability(table("year_filing_for")), "group_persistence": lambda: stability.group_persistence(table("year_filing_for")), "leave_one_year_out": lambda: stability.leave_one_year_out(df), "year_over_year": lambda: stability.year_over_year(df)},
        "panel": {"panel_coverage": lambda: panel.coverage(flags), "panel_transitions": lambda: panel.transitions(flags), "key_drift": lambda: panel.key_drift(df), "permutation_null": lambda: panel.permutation_null(flags, cfg.permutations)},
        "influence": {"exposure": lambda: influence.exposure_concentration(loo), "influence_ranking": lambda: influence.influence_ranking(loo), "trend_reversals": lambda: influence.trend_reversals(df), "decomposition": lambda: influence.kitagawa(table("year_filing_for")), "exclusions": lambda: influence.exclusion_scenarios(df), "accounting": lambda: influence.deletion_accounting(df)},
        "sectors": {"wilson_by_sector": lambda: sectors.wilson_by(df, "naics2"), "sector_ex_top50": lambda: sectors.without_top(df, "naics2"), "detectability": lambda: detectability.detectability(df)},
    }


def run(filings: DataFrame, folder: str, cfg: Config = Config(), stages: tuple[str, ...] | None = None) -> dict:
    """Writes the tables of all stages (or the named ones) below `folder`, and summary.json; returns the summary.

    The screened frame is kept once and serves all stages; only aggregated tables come to the driver.
    """
    df = screened(filings, cfg.bounds).persist(StorageLevel.MEMORY_AND_DISK)
    os.makedirs(folder, exist_ok=True)
    tables, done, sizes = stage_tables(df, cfg), {}, {}
    try:
        for name in topological(LINEAGE, {"filings"}):
            if name == "screen" or (stages and name not in stages):
                continue
            for table, make in tables[name].items():
                out = cut(make(), table)  # written once; the file, the count and the reports are read from there
                write_csv(out, os.path.join(folder, table))
                sizes[table] = out.count()
                if table in REPORTED:
                    if sizes[table] > REPORT_ROWS:
                        raise ValueError(f"{table} has {sizes[table]} rows; reports are made of {REPORT_ROWS} at most")
                    done[table] = rows_of(out)
        summary = {"config": asdict(cfg), "tables": sizes, "overall": done.get("quality_overall", [{}])[0]}
        write_json(summary, os.path.join(folder, "summary.json"))
        if "quality_by_year" in done:
            with open(os.path.join(folder, "quality.md"), "w", encoding="utf-8") as f:
                f.write(render.report("Filing quality", [("By year", "Screened and unscreened rates.", done["quality_by_year"]), ("Flags", "Flags aren't exclusive.", done["flag_prevalence"])]))
            years = sorted(done["quality_by_year"], key=lambda r: r["year_filing_for"])
            with open(os.path.join(folder, "rates.svg"), "w", encoding="utf-8") as f:
                f.write(render.Figure("Screened rate by year", "year", "cases per 200,000 hours").line([r["year_filing_for"] for r in years], [r["aggregate_trir_screened"] for r in years]).svg())
        return summary
    finally:
        df.unpersist()
