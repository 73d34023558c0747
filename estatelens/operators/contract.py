"""Ingestion contract: how a third-party feed maps onto the listing schema.

A contract is a small frozen object on the driver; it only shapes column
expressions and never touches rows.  Its checks run before any Spark job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Units, bases and conversion factors.
AREA_TO_SQFT = {"sqft": 1.0, "sqm": 10.7639, "sqyd": 9.0}
PRICE_TO_CRORE = {"rupees": 1e-7, "lakh": 1e-2, "crore": 1.0}
KNOWN_AREA_BASES = ("carpet", "builtup", "superbuiltup")
UNKNOWN_AREA_BASIS = "unknown"
PPSF_BAND = (1_000.0, 100_000.0)
AREA_BAND = (100.0, 20_000.0)
ALWAYS_REQUIRED = ("price", "area")
PARSER_NAMES = ("numeric", "numeric_or_range", "leading_number", "balcony_label")


@dataclass(frozen=True)
class ListingContract:
    columns: dict                      # target field -> raw column
    area_unit: str
    area_basis: str
    price_unit: str
    locality_column: str
    expected_ppsf_range: tuple[float, float] | None = None
    parse: dict = field(default_factory=dict)            # target field -> parser name
    required_columns: tuple[str, ...] = ()
    area_basis_column: str | None = None
    area_basis_labels: dict = field(default_factory=dict)  # raw label -> basis
    amenity_columns: tuple[str, ...] = ()
    amenity_unknown_value: float | None = None

    def check(self, raw_columns) -> None:
        """Declarations and column presence; raises ``ValueError`` naming the entry."""
        def need(ok: bool, entry: str, what: object) -> None:
            if not ok:
                raise ValueError(f"contract.{entry}: {what}")

        bases = (*KNOWN_AREA_BASES, UNKNOWN_AREA_BASIS)
        for entry, value, known in (("area_unit", self.area_unit, AREA_TO_SQFT), ("price_unit", self.price_unit, PRICE_TO_CRORE),
                                    ("area_basis", self.area_basis, bases)):
            need(value in known, entry, f"{value!r}, known are {sorted(known)}")
        need(set(ALWAYS_REQUIRED) <= set(self.columns), "columns", f"needs {list(ALWAYS_REQUIRED)}, has {sorted(self.columns)}")
        for target, name in self.parse.items():
            need(name in PARSER_NAMES, "parse", f"{target}: {name!r}, known are {list(PARSER_NAMES)}")
            need(target in self.columns, "parse", f"{target} is not in columns")
        sources = [*self.columns.values(), self.locality_column]
        twice = sorted({c for c in sources if sources.count(c) > 1})
        need(not twice, "columns", f"used twice: {twice}")
        flags = [self.area_basis_column] if self.area_basis_column else []
        absent = sorted({*sources, *self.amenity_columns, *flags} - set(raw_columns))
        need(not absent, "columns", f"not in the feed: {absent}")
        carried = set(raw_columns) - set(sources)
        made = {*self.columns, *carried, "sector", "price_per_sqft", *(["amenity_count"] if self.amenity_columns else [])}
        unknown = [c for c in self.required_columns if c not in made]
        need(not unknown, "required_columns", f"no such columns: {unknown}")
        if self.expected_ppsf_range is not None:
            lo, hi = self.expected_ppsf_range
            need(lo < hi, "expected_ppsf_range", f"{lo} is not below {hi}")
        wrong = sorted(set(self.area_basis_labels.values()) - set(bases))
        need(not wrong, "area_basis_labels", f"unknown bases {wrong}")
        need(bool(self.area_basis_column) == bool(self.area_basis_labels), "area_basis_labels", "goes with area_basis_column")
        if self.area_basis_labels:
            need(self.area_basis in self.area_basis_labels.values(), "area_basis_labels", f"no label stands for {self.area_basis!r}")
