"""Column expressions over listing text: prices, quantities, brands, titles, urls.

All of them are built-in expressions that stay inside code generation.  The
patterns carry ``(?U)`` so that digits and white space follow Unicode (a
no-break space after the currency sign is white space).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: brand dictionary (order decides), unit table, patterns ---
BRANDS = [
    ("nestle", "Nestle"),
    ("nestlé", "Nestle"),
    ("knorr", "Knorr"),
    ("ponam", "Ponam"),
    ("sabroso", "Sabroso"),
    ("sufi", "Sufi"),
    ("national", "National"),
    ("shangrila", "Shangrila"),
    ("meezan", "Meezan"),
    ("dalda", "Dalda"),
    ("habib", "Habib"),
    ("tapal", "Tapal"),
    ("lipton", "Lipton"),
    ("lux", "Lux"),
    ("safeguard", "Safeguard"),
    ("lifebuoy", "Lifebuoy"),
    ("surf excel", "Surf Excel"),
    ("ariel", "Ariel"),
    ("sunlight", "Sunlight"),
    ("colgate", "Colgate"),
    ("sensodyne", "Sensodyne"),
    ("pepsodent", "Pepsodent"),
]
UNITS = [
    ("kg", "kg", 1.0),
    ("g", "kg", 0.001),
    ("gm", "kg", 0.001),
    ("gram", "kg", 0.001),
    ("grams", "kg", 0.001),
    ("mg", "kg", 0.000001),
    ("l", "L", 1.0),
    ("liter", "L", 1.0),
    ("liters", "L", 1.0),
    ("ml", "L", 0.001),
    ("dozen", "pcs", 12.0),
    ("doz", "pcs", 12.0),
    ("per dozen", "pcs", 12.0),
    ("per doz", "pcs", 12.0),
    ("pcs", "pcs", 1.0),
    ("pieces", "pcs", 1.0),
]
PRICE_PATTERN = r"Rs\.?\s*([\d,]+(\.\d+)?)"
QUANTITY_PATTERN = (
    r"(\d+(\.\d+)?)\s*"
    r"(kg|g|gm|gram|grams|ml|l|liter|liters|mg|doz|dozen|pcs|pieces|per Dozen|per Doz)"
)
TITLE_UNIT_PATTERN = r"\d+(\.\d+)?\s*(kg|g|gm|ml|l|liter|dozen|pcs|pieces)"
PRICE_TEXT_DECIMAL = r"Rs\.\s*[\d,.]+"
PRICE_TEXT_WHOLE = r"Rs\.?\s*[\d,]+"
DEFAULT_BRAND = "Generic"
DEFAULT_UNIT = "unit"
# --- end of fixed values ---


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern``, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_price(text: Column) -> Column:
    """Number of the last price in ``text``; NULL when there is none."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit("(?U)" + PRICE_PATTERN), F.lit(1)), F.lit(-1))
    return F.regexp_replace(last, ",", "").try_cast("double")


def price_or_name_price(price: Column, name: Column) -> Column:
    """The listed price, else the one written inside the name."""
    return F.coalesce(clean_price(price), clean_price(name))


def _says_per_dozen(name: Column) -> Column:
    return F.lower(name).contains("per doz")


def _unit_token(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "(?iU)" + QUANTITY_PATTERN, 3))


def _unit_lookup(token: Column, position: int) -> Column:
    table = F.create_map(*[F.lit(x) for row in UNITS for x in (row[0], row[position])])
    return F.try_element_at(table, token)


def standard_unit(token: Column) -> Column:
    """Standard unit of a unit word; an unknown word stands for itself."""
    return F.coalesce(_unit_lookup(token, 1), token)


def unit_multiplier(token: Column) -> Column:
    """Factor from a unit word to its standard unit, 1 when unknown."""
    return F.coalesce(_unit_lookup(token, 2), F.lit(1.0))


def quantity_value(name: Column) -> Column:
    """Amount in standard units written in a name (12 for "per dozen", else 1)."""
    number = _first(name, "(?iU)" + QUANTITY_PATTERN, 1).try_cast("double")
    return (
        F.when(_says_per_dozen(name), F.lit(12.0))
        .when(number.isNotNull(), number * unit_multiplier(_unit_token(name)))
        .otherwise(F.lit(1.0))
    )


def quantity_unit(name: Column) -> Column:
    """Standard unit written in a name (``unit`` when there is none)."""
    return (
        F.when(_says_per_dozen(name), F.lit("pcs"))
        .when(_unit_token(name) != "", standard_unit(_unit_token(name)))
        .otherwise(F.lit(DEFAULT_UNIT))
    )


def extract_brand(title: Column, brands: Sequence[tuple[str, str]] = BRANDS) -> Column:
    """First dictionary brand found anywhere in the title, else its first word."""
    lowered = F.lower(title)
    first_word = F.coalesce(_first(title, r"(?U)\S+"), F.lit(DEFAULT_BRAND))
    key, label = brands[0]
    choice = F.when(lowered.contains(key), F.lit(label))
    for key, label in brands[1:]:
        choice = choice.when(lowered.contains(key), F.lit(label))
    return choice.otherwise(first_word)


def resolve_brand(brand: Column, title: Column) -> Column:
    """Keep a stated brand; read the title when it is missing or generic."""
    return F.when(_blank(brand) | (brand == DEFAULT_BRAND), extract_brand(title)).otherwise(brand)


def unit_price(price: Column, quantity: Column) -> Column:
    """Price per standard unit to the cent; NULL for a zero or missing part."""
    return F.when((price != 0) & (quantity > 0), F.round(F.try_divide(price, quantity), 2))


def normalize_title(title: Column) -> Column:
    """Lower case, sizes removed, only letters and digits, single spaces."""
    without_sizes = F.regexp_replace(F.lower(title), "(?U)" + TITLE_UNIT_PATTERN, "")
    return F.coalesce(F.trim(F.regexp_replace(without_sizes, "[^a-z0-9]+", " ")), F.lit(""))


def price_text(text: Column, grammar: str = "decimal") -> Column:
    """First price-looking part of a text.

    ``decimal`` keeps decimals and falls back to the whole text; ``whole`` has
    no decimals and gives NULL when nothing matches.
    """
    if grammar == "decimal":
        return F.coalesce(_first(text, "(?U)" + PRICE_TEXT_DECIMAL), text)
    if grammar == "whole":
        return _first(text, "(?U)" + PRICE_TEXT_WHOLE)
    raise ValueError(f"unknown price grammar {grammar!r}")


def absolutize_url(url: Column, base: str) -> Column:
    """Put the site base before a relative link; empty stays empty."""
    return F.when(_blank(url), F.lit("")).when(url.startswith("http"), url).otherwise(F.concat(F.lit(base), url))


def absolutize_image(url: Column) -> Column:
    """Give a scheme to ``//host/...`` image links."""
    return (
        F.when(_blank(url), F.lit(""))
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .otherwise(url)
    )


def product_url_from_slug(slug: Column, base: str) -> Column:
    return F.when(_blank(slug), F.lit("")).otherwise(F.concat(F.lit(base + "/product/"), slug))


def category_part(path: Column) -> Column:
    """``A`` of the path ``A > B``."""
    return F.split(path, " > ", -1)[0]


def subcategory_part(path: Column) -> Column:
    """``B`` of the path ``A > B``, empty without one."""
    return F.coalesce(F.try_element_at(F.split(path, " > ", -1), F.lit(2)), F.lit(""))
