"""Text helpers: target slugs and the parameter -> unit lookup."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Measurement unit of each water-quality parameter.
PARAMETER_UNITS = {
    "Clorofila a": "μg/L",
    "Turbidez": "NTU",
    "Transparência da Água": "m",
    "Sólidos Dissolvidos Totais": "mg/L",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(c) -> Column:
    """Folder-safe target name: spaces -> '_', lower-case 'á' -> 'a', then lower.

    Only the lower-case 'á' is replaced before lowering, so an upper-case 'Á'
    ends as 'á'; other accents ('ó', 'ê') stay.
    """
    return F.lower(F.replace(F.replace(_c(c), F.lit(" "), F.lit("_")), F.lit("á"), F.lit("a")))


def slug_py(name: str) -> str:
    """Driver-side twin of :func:`slug` for folder names."""
    return name.replace(" ", "_").replace("á", "a").lower()


def unit_of(c, units: dict | None = None) -> Column:
    """Unit of a parameter column, NULL when the parameter is unknown."""
    units = PARAMETER_UNITS if units is None else units
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(units.items())])
    return F.try_element_at(m, _c(c))


def with_unit_label(name: str, units: dict | None = None) -> str:
    """'Actual' -> 'Actual (NTU)' style label for a parameter's unit."""
    units = PARAMETER_UNITS if units is None else units
    return units.get(name, "")
