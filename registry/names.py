"""Column names of the wide table, written out for the SQL twins so that they do not depend on the library."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Names:
    ledger: str = "msd"
    assessed: str = "ird"
    year: int = 2018

    # Names as the wide table has them.
    tax_types: tuple[str, ...] = ("child_support", "families", "GST", "income_tax", "other", "PAYE", "student_loan")
    incomes: tuple[str, ...] = ("WAS_income", "WHP_income", "BEN_income", "total_income")
    ethnicities: tuple[str, ...] = ("eth_asian", "eth_european", "eth_maori", "eth_pacific")
    survey: tuple[str, ...] = (
        "life_satisfaction", "life_worthwhile", "mwi_afford_300_item", "mwi_enough_income", "mwi_material_wellbeing_index",
        "mwi_not_pay_bills_on_time", "sf12_mental_health", "sf12_physical_health",
    )
    survey_steps: tuple[tuple[str, int], ...] = (
        ("mwi_material_wellbeing_index", 2), ("sf12_physical_health", 5), ("sf12_mental_health", 5),
    )
    days: tuple[str, ...] = (
        "benefit", "corrections_any", "corrections_prison", "dead", "employed", "neet", "overseas", "sickness_benefit",
        "social_housing", "study",
    )
    support: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("JS", ("Job Seeker",)), ("SPS", ("Sole Parent Support", "Young Parent Payment")), ("SLP", ("Sickness", "Invalids")),
        ("NZS", ("NZSuper",)), ("OTH", ("Student", "Youth", "Caring For Sick Or Infirm")),
    )
    quarters: tuple[str, ...] = ("2017Q1", "2017Q2", "2017Q3", "2017Q4", "2018Q1", "2018Q2", "2018Q3", "2018Q4")

    @property
    def balances(self) -> list[str]:
        totals = [f"{a}_{q}" for a in ("ird", "msd") for q in self.quarters]
        return totals + [f"ird_Y{q}_{t}" for t in self.tax_types for q in self.quarters]
