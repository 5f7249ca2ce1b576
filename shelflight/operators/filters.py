"""Filters: parameter objects that become one Column.

A bound that is None (or, where the docstring says so, 0) does not filter.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import fields



def all_of(conditions: list[Column]) -> Column:
    """The conjunction of conditions; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def within(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive bounds, each only if it is given; a null value fails a given bound."""
    tests = ([value >= low] if low is not None else []) + ([value <= high] if high is not None else [])
    return F.coalesce(all_of(tests), F.lit(False))


def escaped_like(text: str) -> str:
    """A LIKE pattern for a literal substring."""
    return "%" + text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"


def name_contains(column: Column, text: str) -> Column:
    """Substring search without regard to letter case; % and _ are plain characters."""
    return column.ilike(escaped_like(text))


def name_or_id(name: Column, node_id: Column, text: str) -> Column:
    return F.lower(name).contains(text.lower()) | F.lower(node_id).contains(text.lower())


def fuzzy_name(column: Column, text: str, least: float = 0.3) -> Column:
    """Substring match, or trigram similarity at or above a bound."""
    return name_contains(column, text) | (fields.similarity(column, F.lit(text)) >= least)


def is_blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def depth_is(depth: Column, wanted: int | None, folded_from: int = 5) -> Column:
    """Depth equality, with all depths from ``folded_from`` on in one bucket; None is off."""
    return F.lit(True) if wanted is None else F.least(depth, F.lit(folded_from)) == min(wanted, folded_from)


@dataclass(frozen=True)
class PageFilter:
    """Bounds of a sightings page: inclusive, None is off."""

    list_type: str | None = None
    price_min: float | None = None
    price_max: float | None = None
    rating_min: float | None = None
    rating_max: float | None = None
    review_min: int | None = None
    review_max: int | None = None

    def column(self) -> Column:
        tests = [
            within(F.col("price"), self.price_min, self.price_max),
            within(F.col("rating"), self.rating_min, self.rating_max),
            within(F.col("review_count"), self.review_min, self.review_max),
        ]
        return all_of([*([F.col("list_type") == self.list_type] if self.list_type else []), *tests])


@dataclass(frozen=True)
class ListGate:
    """Gates of a ranked list. 0 is off.

    A missing review count counts as 0, and ``review_max`` itself is rejected;
    the bounds of rating and price are inclusive, and reject null once one is set.
    """

    review_max: int = 0
    review_min: int = 0
    rating_min: float = 0
    rating_max: float = 0
    price_min: float = 0
    price_max: float = 0
    list_limit: int = 0
    min_list_size: int = 0

    def column(self) -> Column:
        reviews = F.coalesce(F.col("review_count"), F.lit(0))
        tests = []
        if self.review_max > 0:
            tests.append(reviews < self.review_max)
        if self.review_min > 0:
            tests.append(reviews >= self.review_min)
        for name, low, high in (
            ("rating", self.rating_min, self.rating_max),
            ("price", self.price_min, self.price_max),
        ):
            tests.append(within(F.col(name), low if low > 0 else None, high if high > 0 else None))
        if self.list_limit > 0:
            tests.append(F.col("list_position") <= self.list_limit)
        if self.min_list_size > 0:
            tests.append(F.col("list_total") >= self.min_list_size)
        return all_of(tests)


@dataclass(frozen=True)
class DetailFilter:
    """Filters on detail fields. 0, '' and None are off; a set filter rejects null."""

    bsr_main_min: float = 0
    bsr_main_max: float = 0
    bsr_sub_min: float = 0
    bsr_sub_max: float = 0
    variant_min: float = 0
    variant_max: float = 0
    sellers_min: float = 0
    sellers_max: float = 0
    weight_min: float = 0
    weight_max: float = 0
    dim_l: float = 0
    dim_w: float = 0
    dim_h: float = 0
    shipping_fee: str = ""  # free, paid or custom
    shipping_op: str = "lte"
    shipping_val: float = 0
    fulfillment_type: str = ""
    country: str = ""
    choice: bool = False
    bestseller: bool = False
    listed_within_days: int | None = None
    date_from: dt.date | None = None
    date_to: dt.date | None = None

    def column(self, as_of: Column | None = None) -> Column:
        """The whole filter; ``as_of`` is needed for ``listed_within_days``."""
        tests = [
            within(value, low or None, high or None)
            for value, low, high in (
                (F.col("bsr_main_rank"), self.bsr_main_min, self.bsr_main_max),
                (F.col("bsr_sub_rank"), self.bsr_sub_min, self.bsr_sub_max),
                (F.col("variant_option_count"), self.variant_min, self.variant_max),
                (F.col("other_sellers_count"), self.sellers_min, self.sellers_max),
                (fields.pounds(F.col("item_weight")), self.weight_min, self.weight_max),
            )
            if low or high
        ]
        sides = fields.inches(F.col("item_dimensions"))
        for at, most in enumerate((self.dim_l, self.dim_w, self.dim_h)):
            if most:
                tests.append(F.coalesce(F.get(sides, F.lit(at)) <= most, F.lit(False)))
        tests += [*self._shipping(), *self._texts()]
        day = F.col("date_first_available")
        if self.listed_within_days is not None:
            if as_of is None:
                raise ValueError("listed_within_days needs as_of")
            tests.append(F.coalesce(fields.age_days(day, as_of) <= self.listed_within_days, F.lit(False)))
        if self.date_from or self.date_to:
            tests.append(within(day, self.date_from, self.date_to))
        return all_of(tests)

    def _shipping(self) -> list[Column]:
        fee = F.col("shipping_fee_value")
        if self.shipping_fee == "free":
            return [F.coalesce(fee <= 0, F.lit(False))]
        if self.shipping_fee == "paid":
            return [F.coalesce(fee != 0, F.lit(False))]
        if self.shipping_fee == "custom":
            bound = {"lte": fee <= self.shipping_val, "gte": fee >= self.shipping_val}.get(self.shipping_op)
            bounded = bound if bound is not None and self.shipping_val > 0 else F.lit(True)
            return [fee.isNotNull() & bounded]
        return []

    def _texts(self) -> list[Column]:
        tests = []
        if self.fulfillment_type:
            tests.append(F.col("fulfillment_type").eqNullSafe(self.fulfillment_type))
        if self.country:
            tests.append(
                F.coalesce(F.lower("country_of_origin").contains(self.country.lower()), F.lit(False))
            )
        if self.choice:
            tests.append(F.col("is_amazon_choice").eqNullSafe(1))
        if self.bestseller:
            tests.append(F.col("is_bestseller").eqNullSafe(1))
        return tests


#: Screening thresholds (fixed values): a coarse and a final preset.
COARSE = PageFilter(price_min=15, price_max=60, review_max=100)
FINAL_REVIEWS, FINAL_COMPETITION = 50, 5000


def screened(competition: Column, final: bool = True) -> Column:
    """The coarse preset, and with ``final`` the caps on reviews and on competing results too; null fails a cap."""
    tests = [COARSE.column()]
    if final:
        tests += [within(F.col("review_count"), None, FINAL_REVIEWS), within(competition, None, FINAL_COMPETITION)]
    return all_of(tests)


#: Words in slugs of categories that are skipped, and words that keep one all the same (fixed values).
SKIP_WORDS = (
    "books", "book", "buch", "fremdsprachig", "lesen",
    "digital", "kindle", "audible", "ebook", "e-book", "digital-text",
    "dmusic", "music-artist", "music",
    "movie", "movies", "film", "dvd", "blu-ray", "prime-video", "instant-video",
    "videogames", "video-games", "videospiele", "game-download",
    "software", "mobile-apps",
    "gift-card", "gift-cards", "geschenkgut",
    "amazon-devices", "amazon-renewed", "amazon-warehouse",
    "collectible-coins", "entertainment-collectibles", "unique-finds",
    "handmade", "boost",
    "fashion", "clothing", "bekleidung", "shoes", "schuhe",
    "jewelry", "schmuck", "watches", "uhren", "luggage", "handbags", "koffer",
    "coins", "collectible", "collectibles",
)
KEEP_WORDS = ("musical-instruments", "musikinstrumente", "appliances", "elektro-grossgerate")


def is_skipped(slug: Column, skip: tuple[str, ...] = SKIP_WORDS, keep: tuple[str, ...] = KEEP_WORDS) -> Column:
    """A slug that holds a skip word and no keep word, letter case ignored."""
    low = F.lower(slug)
    any_of = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words], F.lit(False))
    return F.coalesce(any_of(skip) & ~any_of(keep), F.lit(False))


def keep_and_skip(df: DataFrame, slug: str = "slug") -> tuple[DataFrame, DataFrame]:
    """Rows kept, and rows skipped."""
    flag = is_skipped(F.col(slug))
    return df.where(~flag), df.where(flag)


def search_card_gate(reviews: Column, most: int) -> Column:
    """Coarse gate of a search card: more reviews than ``most`` are rejected, 0 is off."""
    return F.lit(True) if not most else F.coalesce(reviews, F.lit(0)) <= most


def capture_status(html: Column, items: Column) -> Column:
    """Class of a captured search page: error, captcha, no_results, empty or ok."""
    low = F.lower(html)
    return (
        F.when(html.isNull(), "error")
        .when(low.contains("captcha") | low.contains("type the characters") | low.contains("klicke auf die schaltfläche"), "captcha")
        .when(low.contains("keine ergebnisse"), "no_results")
        .when(F.coalesce(items, F.lit(0)) == 0, "empty")
        .otherwise("ok")
    )


def sort_capability(html: Column) -> Column:
    """Class of a page by its sort control: robot, no_select, yes or no."""
    select = F.regexp_extract(html, r'(?s)id="s-result-sort-select".*?</select>', 0)
    options = F.regexp_extract_all(select, F.lit(r'<option[^>]*value="([^"]*)"'), F.lit(1))
    return (
        F.when(html.contains("api-services") | html.contains("Something went wrong"), "robot")
        .when(select == "", "no_select")
        .when(F.array_contains(options, "date-desc-rank"), "yes")
        .otherwise("no")
    )


def capability_flag(capability: Column) -> Column:
    """1 for yes, 0 for no and no_select, null for robot."""
    return F.when(capability == "yes", 1).when(capability.isin("no", "no_select"), 0)


def clamp(value: int | None, default: int, most: int) -> int:
    """A positive argument within a cap; the default for None and for what is no positive number."""
    return min(value, most) if isinstance(value, int) and value > 0 else min(default, most)
