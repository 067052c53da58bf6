"""The wide client table: one lazy plan over all loan tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from loanloom import constants as K
from loanloom.operators import aggregates as A
from loanloom.operators import sampling
from loanloom.operators.applicant import application_features


@dataclass
class Spine:
    """The wide table and what it was built from."""

    table: DataFrame
    used: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def _client_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame | None]:
    """Per-client aggregates of the enrichment tables that are present."""

    def when_present(name: str, build):
        return build(tables[name]) if name in tables else None

    return {
        "bureau": when_present(
            "bureau", lambda b: A.aggregate_bureau(b, tables.get("bureau_balance"))
        ),
        "previous_application": when_present("previous_application", A.aggregate_previous),
        "installments_payments": when_present("installments_payments", A.aggregate_installments),
        "pos_cash": when_present("pos_cash", A.aggregate_pos),
        "credit_card": when_present("credit_card", A.aggregate_card),
    }


def build_spine(
    tables: dict[str, DataFrame],
    include_supplementary: bool = True,
    sample_frac: float | None = None,
    sentinel: str = "null",
    seed: int = 42,
) -> Spine:
    """Application rows, their derived columns and every client aggregate.

    ``tables["app"]`` holds train and test rows together (column ``split``).
    Each fact table is shuffled once, on the client key; the joins reuse that
    partitioning. An enrichment table that is not given is skipped and
    listed in ``skipped``. With ``sample_frac`` (taken of each split) the fact
    tables are filtered by the same key cut-off before they are aggregated.
    """
    app = tables["app"]
    facts = {n: t for n, t in tables.items() if n != "app"}
    if sample_frac is not None:
        strata = ["split"] if "split" in app.columns else []
        cut = sampling.sample_cut(app, K.CLIENT_KEY, sample_frac, seed, strata)
        keep = sampling.keys_up_to(K.CLIENT_KEY, cut, seed)
        app = sampling.sample_fraction(app, K.CLIENT_KEY, sample_frac, seed, strata)
        facts = {n: t.where(keep) if K.CLIENT_KEY in t.columns else t for n, t in facts.items()}
        if "bureau" in facts and "bureau_balance" in facts:
            # balances have no client key: keep those of the sampled clients' credits
            credits = facts["bureau"].select(K.BUREAU_KEY)
            facts["bureau_balance"] = facts["bureau_balance"].join(credits, K.BUREAU_KEY, "left_semi")
    wide = application_features(app, sentinel)
    used, skipped = ["app"], []
    if include_supplementary:
        for name, aggregate in _client_tables(facts).items():
            if aggregate is None:
                skipped.append(name)
                continue
            wide = wide.join(aggregate, K.CLIENT_KEY, "left")
            used.append(name)
    return Spine(wide, used, skipped)
