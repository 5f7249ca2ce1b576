"""Captured pages to rows: ``mapInPandas``-style jobs over (page_id, url, html).

Python only finds the blocks of a page and takes their text; typed values come
from native expressions over those texts (``shelflight.functions``). Unclosed
tags are common, so the page reader keeps open elements loosely.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.functions import fields, urls
from shelflight.sources.tables import first_rows

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = {"ul", "ol", "table", "div", "select", "body"}


class Element:
    """One element: tag, attributes, parent, and its content in order (elements and texts).

    ``order`` numbers the elements of a page as they begin, ``last`` is the number of
    the last one inside; so what lies inside an element is a slice of the page's list.
    """

    __slots__ = ("attrs", "content", "last", "order", "page", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, page: Page):
        self.tag, self.attrs, self.parent, self.content, self.page = tag, attrs, parent, [], page
        self.order = self.last = len(page.elements)
        page.elements.append(self)

    def walk(self) -> list[Element]:
        """The elements inside, in order of the page."""
        return self.page.elements[self.order + 1 : self.last + 1]

    def text(self, between: str = " ") -> str:
        if self.tag in ("script", "style") or not self.content:
            return ""
        if len(self.content) == 1 and isinstance(self.content[0], str):
            return self.content[0].strip()
        parts: list[str] = []
        stack: list = [self]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                if c.strip():
                    parts.append(c.strip())
            elif c.tag not in ("script", "style"):
                stack.extend(reversed(c.content))
        return between.join(parts)

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def classes(self) -> list[str]:
        return self.attrs["class"].split() if "class" in self.attrs else []

    def _candidates(self, test: Callable[[Element], bool]) -> list[Element]:
        """The elements inside that may pass a test: those with one of its keys, or all."""
        keys = getattr(test, "keys", None)
        if keys is None:
            return self.walk()
        places, elements = self.page.index(), self.page.elements
        lists = [own for what, name in keys if (own := places[what].get(name))]
        if not lists:
            return []
        parts = [own[bisect_right(own, self.order) : bisect_right(own, self.last)] for own in lists]
        numbers = parts[0] if len(parts) == 1 else sorted(set().union(*parts))
        return [elements[i] for i in numbers]

    def find(self, *tests: Callable[[Element], bool]) -> Element | None:
        """The first element of the first test that any element passes."""
        for test in tests:
            for e in self._candidates(test):
                if test(e):
                    return e
        return None

    def all(self, test: Callable[[Element], bool]) -> list[Element]:
        return [e for e in self._candidates(test) if test(e)]


class Page:
    """The elements of a page in order, found by (what, name): ``id``, ``class`` or ``tag``."""

    def __init__(self):
        self.elements: list[Element] = []
        self.places: dict[str, dict[str, list[int]]] | None = None
        self.covers: dict[Callable, tuple[list[int], list[int]]] = {}

    def index(self) -> dict[str, dict[str, list[int]]]:
        """The numbers of the elements by ``id``, ``class`` or ``tag``, and then by name."""
        if self.places is None:
            tags, ids, classes = {}, {}, {}
            for e in self.elements:
                tags.setdefault(e.tag, []).append(e.order)
                if e.attrs:
                    if name := e.attrs.get("id"):
                        ids.setdefault(name, []).append(e.order)
                    if "class" in e.attrs:
                        for c in dict.fromkeys(e.classes()):
                            classes.setdefault(c, []).append(e.order)
            self.places = {"tag": tags, "id": ids, "class": classes}
        return self.places

    def release(self) -> None:
        """Let go of the elements, which hold each other: they are freed at once, not by the collector of cycles."""
        for e in self.elements:
            e.parent = e.page = None
        self.elements = []

    def covered(self, outer: Callable[[Element], bool], e: Element) -> bool:
        """Whether an element lies inside one that passes ``outer``."""
        if outer not in self.covers:
            found = self.elements[0].all(outer)
            self.covers[outer] = [o.order for o in found], list(accumulate((o.last for o in found), max))
        orders, furthest = self.covers[outer]
        # of those that begin before it, one that ends behind its beginning holds it
        k = bisect_left(orders, e.order)
        return k > 0 and furthest[k - 1] >= e.order


class _Reader(HTMLParser):
    """Keeps the open elements as a path, and where on it each tag stands, so that no tag looks for its partner step by step."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.path = [Element("", {}, None, self.page)]
        self.open: dict[str, list[int]] = {}
        self.barriers = [0]  # where on the path barriers stand, outermost first

    def _cut(self, length: int) -> None:
        last, path = len(self.page.elements) - 1, self.path
        while len(path) > length:
            ended = path.pop()
            ended.last = last  # what began while it was open lies inside
            self.open[ended.tag].pop()
        while self.barriers[-1] >= length:
            self.barriers.pop()

    def whole(self) -> Element:
        """The root, when all is read."""
        self._cut(1)
        self.path[0].last = len(self.page.elements) - 1
        return self.path[0]

    def handle_starttag(self, tag, attrs):
        self.begin(tag, {k: v or "" for k, v in attrs})

    def begin(self, tag: str, attrs: dict[str, str]) -> None:
        path = self.path
        if closes := _CLOSES.get(tag):
            barrier = self.barriers[-1]
            opened = [own[bisect_right(own, barrier)] for c in closes if (own := self.open.get(c)) and own[-1] > barrier]
            if opened:
                self._cut(min(opened))
        element = Element(tag, attrs, path[-1], self.page)
        path[-1].content.append(element)
        if tag not in _VOID:
            if tag in self.open:
                self.open[tag].append(len(path))
            else:
                self.open[tag] = [len(path)]
            if tag in _BARRIER:
                self.barriers.append(len(path))
            path.append(element)

    def handle_endtag(self, tag):
        if own := self.open.get(tag):
            self._cut(own[-1])

    def handle_data(self, data):
        self.path[-1].content.append(data)


#: A piece of plain markup: a text, a start tag with its attributes, an end tag, a comment or a document type.
_PIECE = re.compile(
    r"""([^<]++)
  | <(?:([a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\r\n\f]++[a-zA-Z][\w:.-]*+(?:="[^"]*+"|='[^']*+')?+(?=[ \t\r\n\f/>]))*+)[ \t\r\n\f]*+(/?+)>
  | /([a-zA-Z][a-zA-Z0-9]*+)[ \t\r\n\f]*+>
  | !--(?!-?>)(?:[^-]++|-(?!-))*+-->
  | ![dD][oO][cC][tT][yY][pP][eE][^>]*+>)""",
    re.X | re.A,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:.-]*+)(?:="([^"]*+)"|='([^']*+)')?+""", re.A)


def _tag_of(m: re.Match) -> tuple[str, dict[str, str] | None, bool]:
    """Name, attributes (None for an end tag) and whether a matched tag ends itself; no name for comments and document types."""
    if m.lastindex is None:
        return "", {}, False
    if m.lastindex == 5:
        return m[5].lower(), None, False
    attrs = {}
    for name, one, two in _ATTRIBUTE.findall(m[3]) if m[3] else ():
        value = one or two
        attrs[name.lower()] = unescape(value) if "&" in value else value
    return m[2].lower(), attrs, bool(m[4])


#: Longer tags are not remembered.
LONGEST_TAG = 200


@lru_cache(4096)
def _known_tag(markup: str) -> tuple[str, dict[str, str] | None, bool] | None:
    """A tag by its markup, of which pages repeat few; its attributes are shared by all elements, which never change them."""
    m = _PIECE.fullmatch(markup)
    return m and _tag_of(m)


def _read_plain(html: str, reader: _Reader, first_of: tuple[Callable[[Element], bool], ...] = ()) -> bool:
    """Read a page of plain markup as ``HTMLParser`` would; False, with the reader unfit for use, where any of it is not plain.

    With ``first_of`` only as far as the first elements that pass each of these tests have ended; those of ``holds`` that
    the page holds nowhere are not waited for.
    """
    at, raw, path, elements = 0, None, reader.path, reader.page.elements
    waiting = [t for t in first_of if not hasattr(t, "holds") or t.holds in html or "&" in html]
    until: list[Element] = []
    while True:
        start = html.find("<", at)
        text = html[at:start] if start >= 0 else html[at:]
        if text:
            path[-1].content.append(unescape(text) if "&" in text and not raw else text)
        if start < 0:
            return raw is None
        at = html.find(">", start) + 1
        found = _known_tag(html[start:at]) if start < at <= start + LONGEST_TAG else None
        if found is None:  # long, or with a ">" inside, or not plain
            m = _PIECE.match(html, start)
            if m is None:
                return False
            at, found = m.end(), _tag_of(m)
        tag, attrs, ends = found
        if attrs is None:
            if raw and raw != tag:
                return False
            reader.handle_endtag(tag)
            raw = None
        elif raw:
            return False  # markup inside a script
        elif tag:
            reader.begin(tag, attrs)
            if ends:
                reader.handle_endtag(tag)
            elif tag in reader.CDATA_CONTENT_ELEMENTS:
                raw = tag
            if waiting:
                passed = [t for t in waiting if t(elements[-1])]
                waiting = [t for t in waiting if t not in passed]
                until += elements[-1:] * bool(passed)
        if first_of and not waiting and all(e not in path for e in until):
            return True


def read_page(html: str | None, first_of: tuple[Callable[[Element], bool], ...] = ()) -> Element:
    """The root of a page's elements. Plain markup is read by one pattern, all other pages by ``HTMLParser``, which takes several times as long.

    With ``first_of`` what comes behind the first elements that pass these tests may be missing.
    """
    reader = _Reader()
    if not _read_plain(html or "", reader, first_of):
        reader = _Reader()
        reader.feed(html or "")
        reader.close()
    return reader.whole()


def _found(make: Callable[[Element, str], Iterator[dict]], html: str | None) -> Iterator[dict]:
    """What ``make`` gives for a page, which is gone afterwards. Of a page is read what ``make.first_of`` says, or all."""
    root = read_page(html, getattr(make, "first_of", ()))
    page = root.page
    yield from make(root, html or "")
    page.release()


def _keyed(test: Callable[[Element], bool], *keys: tuple[str, str]) -> Callable[[Element], bool]:
    """A test that only elements with one of the keys can pass."""
    test.keys = keys
    return test


def has_id(*names: str) -> Callable[[Element], bool]:
    return _keyed(lambda e: e.get("id") in names, *[("id", n) for n in names])


def has_class(*names: str) -> Callable[[Element], bool]:
    return _keyed(lambda e: any(n in e.classes() for n in names), *[("class", n) for n in names])


def is_tag(*tags: str, where: Callable[[Element], bool] | None = None) -> Callable[[Element], bool]:
    return _keyed(lambda e: e.tag in tags and (where is None or where(e)), *[("tag", t) for t in tags])


def inside(outer: Callable[[Element], bool], inner: Callable[[Element], bool]) -> Callable[[Element], bool]:
    def test(e: Element) -> bool:
        return inner(e) and e.page.covered(outer, e)

    return _keyed(test, *inner.keys) if hasattr(inner, "keys") else test


def _text(e: Element | None) -> str | None:
    return e.text() if e is not None else None


#: Rows that a task holds before it hands them on.
ROWS_AT_ONCE = 500


def _per_page(pages: DataFrame, schema: str, make: Callable[[Element, str], Iterator[dict]], keep: tuple[str, ...]) -> DataFrame:
    """A row for each dict that ``make`` gives for a page, with the page's ``keep`` columns."""
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", schema)]
    found_types = [f.type for f in to_arrow_schema(T.StructType.fromDDL(schema))]
    whole = T.StructType([*[pages.schema[k] for k in keep], *T.StructType.fromDDL(schema)])

    def table(kept: list[pa.Array], at: list[int], values: list[list]) -> pa.RecordBatch:
        own = [c.take(pa.array(at, pa.int32())) for c in kept]
        return pa.RecordBatch.from_arrays([*own, *map(pa.array, values, found_types)], names=[*keep, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.columns[:-1]
            at, values = [], [[] for _ in names]
            for n, html in enumerate(batch.column(len(kept)).to_numpy(zero_copy_only=False)):
                for found in _found(make, html):
                    at.append(n)
                    for own, name in zip(values, names):
                        value = found.get(name)
                        own.append(list(value.items()) if type(value) is dict else value)
                if len(at) >= ROWS_AT_ONCE:
                    yield table(kept, at, values)
                    at, values = [], [[] for _ in names]
            if at:
                yield table(kept, at, values)

    return pages.select(*keep, "html").mapInArrow(run, whole)


# --- ranked lists ------------------------------------------------------------

_CARD = (lambda e: e.get("id").startswith("gridItemRoot"), has_class("zg-grid-general-faceout"))
_PRICE = inside(has_class("a-price"), has_class("a-offscreen"))
_STRUCK = inside(has_class("a-text-price"), has_class("a-offscreen"))
_LINK = is_tag("a", where=lambda e: bool(e.get("href")))
_ITEM_LINK = is_tag("a", where=lambda e: "/dp/" in e.get("href"))
_SPANNED = inside(is_tag("span"), is_tag("div"))
_SMALL = is_tag("span", where=lambda e: "a-size-small" in e.classes())
_SMALL_LINK = inside(is_tag("a", where=lambda e: "a-size-small" in e.classes()), is_tag("span"))
_TOTAL = inside(has_class("a-spacing-small"), is_tag("span"))
_BADGE_CLASSES = {"a-badge", "a-badge-label", "a-badge-label-inner"}
_BADGE = lambda e: bool(e.attrs) and (bool(e.get("data-a-badge-type")) or not _BADGE_CLASSES.isdisjoint(e.classes()))


def _cards(page: Element) -> list[Element]:
    return page.all(_CARD[0]) or page.all(_CARD[1])


def _badges(e: Element) -> str:
    found = e.all(_BADGE)
    return " ".join([*[b.get("data-a-badge-type") for b in found], *[b.text() for b in found]]).strip()


def _card(card: Element) -> dict | None:
    link = card.find(_ITEM_LINK)
    if link is None:
        return None
    image = card.find(is_tag("img"))
    truncated = lambda e: any("line-clamp" in c or "truncate" in c for c in e.classes())
    name = card.find(truncated, _SPANNED)
    price = card.find(_PRICE, lambda e: any("sc-price" in c for c in e.classes()))
    return {
        "href": link.get("href"),
        "name": _text(name) or "",
        "image_url": image.get("src") if image is not None else None,
        "price_raw": _text(price),
        "original_price": _text(card.find(_STRUCK)),
        "discount_pct": _text(card.find(has_class("a-badge-label-inner"), lambda e: e.get("data-a-badge-color") == "sx-orange")),
        "rating_text": _text(card.find(has_class("a-icon-alt"))),
        "review_text": _text(
            card.find(
                _SMALL_LINK,
                _SMALL,
            )
        ),
        "rank_text": _text(card.find(has_class("zg-badge-text"))),
        "has_video": int(card.find(has_class("vse-video-badge", "a-icon-vse")) is not None),
        "badges": _badges(card),
    }


CARD_FIELDS = (
    "idx int, n_cards int, href string, name string, image_url string, price_raw string, original_price string, "
    "discount_pct string, rating_text string, review_text string, rank_text string, has_video int, badges string"
)


def _chart(page: Element, _: str = "") -> Iterator[dict]:
    cards = _cards(page)
    for i, card in enumerate(cards):
        if (found := _card(card)) is not None:
            yield found | {"idx": i, "n_cards": len(cards)}


def chart_cards(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Raw texts of the item cards of ranked-list pages; cards without an item link are left out."""


    return _per_page(pages, CARD_FIELDS, _chart, keep)


def chart_rows(cards: DataFrame, domain: Column) -> DataFrame:
    """Typed sightings of cards that carry the locale columns of their site (``with_locale``)."""
    choice, best = fields.badge_flags(F.col("badges"))
    rank = F.regexp_replace("rank_text", "^#+", "")
    return cards.withColumns(
        {
            "asin": urls.item_id(F.col("href")),
            "product_url": urls.absolute_url(domain, F.col("href")),
            "price": fields.locale_number(F.col("price_raw"), F.col("decimal_sep")),
            "rating": fields.locale_rating(F.col("rating_text"), F.col("rating_pattern")),
            "review_count": fields.list_review_count(F.col("review_text")),
            "rank": F.when(rank.rlike(r"^\d+$"), rank.try_cast("int")),
            "is_amazon_choice": choice,
            "is_bestseller": best,
        }
    ).where("asin is not null")


#: Parts of the classes that mark a card's percent change (fixed values).
PERCENT_CLASSES = ("zg-percent-change", "percent")
MOVER_FIELDS = "name string, price_raw string, rating_text string, image_url string, texts array<string>"


def _movers(page: Element, _: str = "") -> Iterator[dict]:
    for card in _cards(page):
        found = _card(card) or {}
        marked = card.find(*[lambda e, n=n: any(n in c for c in e.classes()) for n in PERCENT_CLASSES])
        texts = [c for e in card.walk() for c in e.content if isinstance(c, str) and c.strip()]
        yield found | {"texts": [t.strip() for t in [*([marked.text()] if marked is not None else []), *texts]]}


def mover_cards(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Name, price, rating, percent change and image of the cards of a mover page.

    The change is the text of an element marked by its class, else the card's
    first text with a percent sign.
    """


    raw = _per_page(pages, MOVER_FIELDS, _movers, keep)
    return raw.withColumn("percent_change", fields.percent_change(F.col("texts"))).drop("texts")


# --- search pages ------------------------------------------------------------

RESULT_FIELDS = "idx int, asin string, review_text string, has_next boolean, total_text string"


def _results(page: Element, _: str = "") -> Iterator[dict]:
    total = _text(page.find(_TOTAL))
    following = page.find(lambda e: "s-pagination-next" in e.classes() and "s-pagination-disabled" not in e.classes())
    cards = page.all(lambda e: e.get("data-component-type") == "s-search-result" and bool(e.get("data-asin").strip()))
    for i, card in enumerate(cards):
        reviews = card.find(
            lambda e: e.tag == "a" and ("customerReviews" in e.get("href") or "#reviews" in e.get("href")),
            lambda e: {"a-size-base", "s-underline-text"} <= set(e.classes()),
        )
        yield {
            "idx": i,
            "asin": card.get("data-asin").strip(),
            "review_text": _text(reviews),
            "has_next": following is not None,
            "total_text": total,
        }


def search_cards(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(idx, asin, review_text, has_next, total_text) for each result card with an item id."""


    return _per_page(pages, RESULT_FIELDS, _results, keep)


def search_status(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """(page_id, status, count, has_next) of every captured search page."""
    from shelflight.operators.filters import capture_status

    counts = cards.groupBy("page_id").agg(F.count("*").alias("count"), F.max("has_next").alias("has_next"))
    joined = pages.select("page_id", "html").join(counts.hint("merge"), "page_id", "left")
    return joined.select(
        "page_id",
        capture_status(F.col("html"), F.col("count")).alias("status"),
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("has_next", F.lit(False)).alias("has_next"),
    )


# --- detail pages ------------------------------------------------------------

_VIDEO_CLASSES = ("vse-player-container", "a-icon-vse")
_TWISTER_ITEM = inside(has_id("twister_feature_div"), is_tag("li", where=lambda e: bool(e.get("data-defaultasin"))))
_BULLET = inside(has_id("feature-bullets"), is_tag("li"))
_ALT_IMAGE = inside(has_id("altImages"), is_tag("img"))
_CORE_PRICE = inside(has_id("corePrice_feature_div"), has_class("a-offscreen"))
_STARS = inside(has_id("acrPopover"), has_class("a-icon-alt"))
_EXTRA_BADGE = has_id("acBadge_feature_div", "zeitgeistBadge_feature_div", "badge_feature_div")
_MERCHANT = (has_id("merchant-info"), has_id("merchantInfoFeature"))
_OFFER = (has_class("offer-display-feature-text"), has_id("tabular-buybox"))
_DISCOUNT = (has_class("savingsPercentage"), has_id("dealprice_savings"))
_SCRIPT, _A, _CELL, _OFFERED = is_tag("script"), is_tag("a"), is_tag("th", "td"), has_id("aod-offer")
_ROW_BLOCKS = has_id(
    "detailBullets_feature_div", "productDetails_techSpec_section_1", "productDetails_detailBullets_sections1", "prodDetails"
)
_BLOCK_ROW, _BLOCK_TR = inside(_ROW_BLOCKS, is_tag("li", "tr")), inside(_ROW_BLOCKS, is_tag("tr"))
_OVERVIEW_TR = inside(has_id("productOverview_feature_div", "poExpander"), is_tag("tr"))
DETAIL_BLOCKS = (
    "title string, price_text string, rating_text string, review_text string, image_url string, ranks_text string, "
    "rows array<string>, attributes map<string,string>, overview map<string,string>, variants int, bullets int, "
    "images int, sellers_text string, delivery_text string, merchant_text string, offer_text string, badges string, "
    "breadcrumbs array<string>, stars_text string, json_ld string, description string, brand_url string, "
    "original_price string, discount_text string, has_video boolean, bullet_texts array<string>, variant_labels array<string>, "
    "buybox_texts array<string>, item_input string, parent_input string, n_json_ld int, has_twister_data boolean, "
    "n_offers int, blocks map<string,string>"
)

#: Groups of a detail page's fields, each with the element ids it is read from, the first that the page has; ``*`` stands
#: for any beginning. ``?`` asks only whether there is one (fixed values).
GROUPS = {
    "core": {"title": "productTitle", "brand_text": "bylineInfo"},
    "price": {
        "coupon_text": "couponBadgeRegularVpc vpcButton", "has_coupon": "?couponBadgeRegularVpc vpcButton",
        "vat_message": "vatMessage_feature_div", "twister_plus_price": "tp_price_block_total_price_ww",
        "deal_price": "priceblock_dealprice dealprice_feature_div", "has_deal_badge": "?dealBadge_feature_div",
    },
    "ratings": {
        "review_count": "acrCustomerReviewText", "qa_count": "askATFLink", "bestseller_badge": "zeitgeistBadge_feature_div",
        "social_proof": "socialProofingAsinFaceout_feature_div",
    },
    "media": {
        "has_product_videos_widget": "?ive-videos-for-this-product-widget_feature_div", "has_3d_view": "?rhapsodyARIngress_feature_div",
    },
    "description": {"has_aplus": "?aplus_feature_div aplus", "has_brand_story": "?aplusBrandStory_feature_div"},
    "variants": {"has_size_chart": "?sizeChartV2Data_feature_div"},
    "delivery": {
        "availability": "availability availabilityInsideBuyBox_feature_div",
        "delivery_message": "deliveryBlockMessage deliveryBlock_feature_div mir-layout-DELIVERY_BLOCK",
        "merchant_info": "merchant-info merchantInfoFeature_feature_div",
        "offer_display": "offerDisplayFeatures_desktop offer-display-features", "seller_name": "sellerProfileTriggerId",
        "has_quantity_selector": "?quantityRelocate_feature_div quantity", "has_add_to_cart": "?add-to-cart-button",
        "has_buy_now": "?buy-now-button",
    },
    "returns": {
        "return_policy": "returnsInfoFeature_feature_div productSupportAndReturnPolicy-return_policy_feature_div",
        "warranty_info": "dynamicLegalWarrantyInfoFeature_feature_div",
        "secure_transaction": "dynamicSecureTransactionFeature_feature_div", "package_info": "dynamicPackageInfoFeature_feature_div",
    },
    "marketing": {
        "promotion_text": "promoPriceBlockMessage_feature_div", "has_fbt": "?sims-fbt sims-fbt-form",
        "has_comparison_table": "?HLCXComparisonTable *ComparisonTable",
        "has_gift_option": "?dynamicGiftWrapInfoFeature_feature_div giftwrap_feature_div gift-wrap",
        "has_climate_pledge": "?climatePledgeFriendlyATF_feature_div climatePledgeFriendlyBTF_feature_div climatePledgeFriendly",
        "has_sponsored_section": "?sp_detail sponsoredProducts2-2_feature_div sp_detail2",
        "has_subscribe_save": "?snsDetailPageFeature sns-feature snsAccordion sns-base-price",
        "other_sellers_text": "olp_feature_div", "frequently_returned_warning": "dpFrequentlyReturnedMessage",
    },
    "brand": {"brand_snapshot": "brandSnapshot_feature_div"},
    "safety": {
        "eu_product_safety": "legalEUBtf_feature_div legalEUAtf_feature_div", "energy_efficiency": "energyEfficiency_feature_div",
        "safety_resources": "buffetServiceCard_feature_div", "important_info": "importantInformation_feature_div",
        "safety_warning": "cpsiaProductSafetyWarning-2_feature_div", "product_documents": "productDocuments_feature_div",
    },
    "related": {
        "has_similar_products": "?*sims-simsContainer_feature_div", "has_discovery_inspiration": "?*sims-discoveryAndInspiration",
        "whats_in_box": "postPurchaseWhatsInTheBox_MP_feature_div", "has_newer_version": "?newerVersion_feature_div",
    },
    "review_section": {"has_reviews_section": "?customer-reviews_feature_div"},
    "stock": {"fod_message": "fod-cx-box fodcx_feature_div", "no_featured_offer": "?outOfStockBuyBox_feature_div"},
}
_BLOCK_IDS = {i for fields_ in GROUPS.values() for spec in fields_.values() for i in spec.lstrip("?").split()} | {"productDescription"}
_ANYWHERE = tuple(i[1:] for i in _BLOCK_IDS if i.startswith("*"))


def _table(page: Element, test: Callable[[Element], bool]) -> list[tuple[str, str]]:
    """Key and value cells of the rows that pass a test."""
    pairs = []
    for row in page.all(test):
        cells = [c.text() for c in row.all(_CELL)]
        if len(cells) >= 2 and cells[0]:
            pairs.append((cells[0].strip(" :"), cells[1]))
    return pairs


def _details(page: Element, _: str = "", only: frozenset[str] | None = None, ids: frozenset[str] = frozenset(_BLOCK_IDS)) -> Iterator[dict]:
    """All blocks of a page, or only those named, and in ``blocks`` those of some element ids."""
    wanted = lambda *names: only is None or not only.isdisjoint(names)
    by_id: dict[str, Element] = {}
    for name, places in page.page.index()["id"].items():  # in the order in which ids first come
        by_id[name] = first = page.page.elements[places[0]]
        for part in _ANYWHERE:
            if part in name:
                by_id.setdefault(f"*{part}", first)
    block = lambda *ids: next((by_id[i] for i in ids if i in by_id), None)
    rows = page.all(_BLOCK_ROW) if wanted("rows", "attributes") else []
    attributes = {}
    if wanted("attributes"):
        bullets = [r.text().split(":", 1) for r in rows if r.tag == "li"]
        attributes = dict(_table(page, _BLOCK_TR))
        attributes |= {k.strip(): v.strip() for k, v in (b for b in bullets if len(b) == 2) if k.strip()}
    image = block("landingImage", "imgBlkFront")
    crumbs = block("wayfinding-breadcrumbs_feature_div")
    scripts = page.all(_SCRIPT) if wanted("json_ld", "n_json_ld", "has_twister_data") else []
    linked_data = [e for e in scripts if e.get("type") == "application/ld+json"]
    source = lambda e: "".join(c for c in e.content if isinstance(c, str))
    extra = page.all(_EXTRA_BADGE) if wanted("badges") else []
    brand, twister, buybox = block("bylineInfo"), block("twister_feature_div", "twisterContainer"), block("tabular-buybox")
    points = block("feature-bullets")
    value = lambda *ids: next((by_id[i].get("value") for i in ids if i in by_id), None)
    found = {
        "title": lambda: _text(block("productTitle")),
        "price_text": lambda: _text(page.find(_CORE_PRICE, _PRICE)),
        "rating_text": lambda: _text(page.find(_STARS)),
        "review_text": lambda: _text(block("acrCustomerReviewText")),
        "image_url": lambda: (image.get("data-old-hires") or image.get("src")) if image is not None else None,
        "ranks_text": lambda: _text(block("prodDetails", "detailBulletsWrapper_feature_div", "productDetails_db_sections")),
        "rows": lambda: [r.text() for r in rows],
        "attributes": lambda: attributes,
        "overview": lambda: dict(_table(page, _OVERVIEW_TR)),
        "variants": lambda: len(page.all(_TWISTER_ITEM)),
        "bullets": lambda: len(page.all(_BULLET)),
        "images": lambda: len(page.all(_ALT_IMAGE)),
        "sellers_text": lambda: _text(block("olp_feature_div", "aod-offer-list")),
        "delivery_text": lambda: _text(block("mir-layout-DELIVERY_BLOCK", "deliveryBlockMessage")),
        "merchant_text": lambda: _text(page.find(*_MERCHANT)),
        "offer_text": lambda: _text(page.find(*_OFFER)),
        "badges": lambda: " ".join([_badges(page), *[e.text() for e in extra]]).strip(),
        "breadcrumbs": lambda: [a.text() for a in crumbs.all(_A)] if crumbs is not None else [],
        "stars_text": lambda: _text(block("histogramTable")),
        "json_ld": lambda: source(linked_data[0]) if linked_data else None,
        "description": lambda: _text(block("productDescription", "aplus")),
        "brand_url": lambda: brand.get("href") if brand is not None else None,
        "original_price": lambda: _text(page.find(_STRUCK)),
        "discount_text": lambda: _text(page.find(*_DISCOUNT)),
        "has_video": lambda: any("videoCount" in c or c in _VIDEO_CLASSES for c in page.page.index()["class"]) or "vse-vw-dp-container" in by_id,
        "bullet_texts": lambda: [t for e in points.all(has_class("a-list-item")) if (t := e.text())] if points is not None else [],
        "variant_labels": lambda: [e.text().rstrip(":") for e in twister.all(has_class("a-form-label"))] if twister is not None else [],
        "buybox_texts": lambda: [e.text() for e in buybox.all(has_class("tabular-buybox-text"))] if buybox is not None else [],
        "item_input": lambda: value("ASIN"),
        "parent_input": lambda: value("parentAsin", "parentASIN"),
        "n_json_ld": lambda: len(linked_data),
        "has_twister_data": lambda: any("twister-js-init" in (t := source(e)) or "dimensionValuesDisplayData" in t for e in scripts),
        "n_offers": lambda: len(page.all(_OFFERED)),
        "blocks": lambda: {i: by_id[i].text() for i in ids if i in by_id},
    }
    yield {name: make() for name, make in found.items() if wanted(name)}


#: The blocks that ``detail_fields``, ``arrival_fields`` and ``flat_probe`` read.
FIELD_BLOCKS = ("title", "ranks_text", "rows", "variants", "sellers_text", "delivery_text", "merchant_text", "offer_text", "badges")
ARRIVAL_BLOCKS = ("price_text", "rating_text", "review_text", "ranks_text", "rows", "delivery_text", "merchant_text", "offer_text")
PROBE_BLOCKS = (
    "title", "price_text", "rating_text", "review_text", "image_url", "ranks_text", "attributes", "variants", "images", "sellers_text",
    "delivery_text", "breadcrumbs", "brand_url", "original_price", "discount_text", "has_video", "bullet_texts", "variant_labels",
    "buybox_texts", "item_input", "n_offers", "blocks",
)


def detail_blocks(
    pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), only: tuple[str, ...] | None = None, ids: frozenset[str] = frozenset(_BLOCK_IDS)
) -> DataFrame:
    """The text blocks of item detail pages, or only those named, one row for each page; ``blocks`` holds those of ``ids``."""
    if only is None:
        return _per_page(pages, DETAIL_BLOCKS, _details, keep)
    schema = ", ".join(c for c in re.split(r", (?![^<]*>)", DETAIL_BLOCKS) if c.split()[0] in only)
    return _per_page(pages, schema, partial(_details, only=frozenset(only), ids=ids), keep)


def _labelled(attribute: str) -> Column:
    """The rows that hold a label of an attribute."""
    return F.filter("rows", lambda r: fields.has_label(r, attribute))


def _first_of(attribute: str, value: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(F.transform(_labelled(attribute), value), lambda v: v.isNotNull()), F.lit(0))


def _last_of(attribute: str, value: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(F.transform(_labelled(attribute), value), lambda v: v.isNotNull()), F.lit(-1))


def detail_fields(blocks: DataFrame) -> DataFrame:
    """Typed enrichment fields of detail blocks; what a page lacks is null."""
    choice, best = fields.badge_flags(F.col("badges"), detail=True)
    main, sub, _ = fields.split_ranks(F.col("ranks"))
    return (
        blocks.withColumn("ranks", fields.sales_ranks(F.col("ranks_text")))
        .withColumns(
            {
                "is_amazon_choice": choice,
                "is_bestseller": best,
                "bsr_main_rank": main["rank"],
                "bsr_main_category": main["category"],
                "bsr_sub_rank": sub["rank"],
                "bsr_sub_category": sub["category"],
                "date_first_available": _last_of("date", fields.month_date),
                "item_weight": _last_of("weight", fields.weight_text),
                "item_dimensions": _last_of("dimensions", fields.dimensions_text),
                "country_of_origin": _last_of("origin", fields.country),
                "variant_option_count": F.when(F.col("variants") > 0, F.col("variants")),
                "other_sellers_count": fields.seller_count(F.col("sellers_text")),
                "shipping_fee": fields.shipping_text(F.col("delivery_text")),
                "shipping_fee_value": fields.shipping_value(F.col("delivery_text")),
                "fulfillment_type": fields.fulfilment(F.col("merchant_text"), F.col("offer_text")),
            }
        )
        .drop("ranks")
    )


def arrival_fields(blocks: DataFrame, decimal_sep: Column) -> DataFrame:
    """Typed fields of an arrival's detail blocks."""
    main, _, _ = fields.split_ranks(F.col("ranks"))
    rest = F.slice("ranks", F.lit(2), F.greatest(F.size("ranks"), F.lit(1)))
    return (
        blocks.withColumn("ranks", fields.sales_ranks_cut(F.col("ranks_text")))
        .withColumns(
            {
                "price": F.col("price_text"),
                "price_value": fields.locale_number(F.col("price_text"), decimal_sep),
                "review_count": F.coalesce(fields.count_number(F.col("review_text")), F.lit(0)),
                "rating": F.translate(F.nullif(F.regexp_extract("rating_text", r"[\d,.]+", 0), F.lit("")), ",", ".").try_cast("double"),
                "listing_date": _first_of("date", fields.month_date),
                "bsr_main_category": main["category"],
                "bsr_main_rank": main["rank"],
                "bsr_sub": F.when(F.size("ranks") > 1, rest),
                "shipping_fee": fields.shipping_text(F.col("delivery_text")),
                "shipping_fee_value": fields.shipping_value(F.col("delivery_text")),
                "fulfillment_type": fields.fulfilment(F.col("merchant_text"), F.col("offer_text")),
            }
        )
        .drop("ranks")
    )


def block_text(spec: str) -> Column:
    """The text of the first block that a page has of some element ids; null where it has none or it is empty."""
    return F.nullif(F.coalesce(*[F.try_element_at("blocks", F.lit(i)) for i in spec.lstrip("?").split()]), F.lit(""))


def has_block(spec: str) -> Column:
    """Whether a page has a block of any of some element ids."""
    return F.coalesce(F.arrays_overlap(F.map_keys("blocks"), F.array(*[F.lit(i) for i in spec.lstrip("?").split()])), F.lit(False))


def _group(name: str, more: dict[str, Column] | None = None) -> Column:
    """The struct of a group: its fields from blocks, and ``more``."""
    own = {f: has_block(spec) if spec.startswith("?") else block_text(spec) for f, spec in GROUPS.get(name, {}).items()}
    return F.struct(*[c.alias(f) for f, c in (own | (more or {})).items()]).alias(name)


def inventory(blocks: DataFrame) -> DataFrame:
    """Nested record of all fields found on a page: 19 groups, open attributes as maps, and typed ranks and sizes.

    What a page lacks is null, false, 0 or empty.
    """
    typed = detail_fields(blocks)
    c = F.col
    return typed.select(
        "page_id",
        _group(
            "core",
            {"brand_url": c("brand_url"), "has_brand_store": F.coalesce(c("brand_url").contains("/stores/"), F.lit(False)), "asin": c("item_input")},
        ),
        _group("price", {"price": c("price_text"), "original_price": c("original_price"), "discount_pct": c("discount_text")}),
        _group("ratings", {"rating": c("rating_text"), "bsr_raw": c("ranks_text"), "is_amazons_choice": c("is_amazon_choice") == 1}),
        _group("media", {"main_image_url": c("image_url"), "image_count": c("images"), "has_video": c("has_video")}),
        F.struct("breadcrumbs").alias("category"),
        _group(
            "description",
            {
                "bullet_count": F.size("bullet_texts"),
                "bullets_sample": F.left(F.get("bullet_texts", F.lit(0)), F.lit(100)),
                "has_description": fields.present(c("description"), 20),
            },
        ),
        "attributes",
        "overview",
        _group("variants", {"variant_dimensions": c("variant_labels"), "variant_option_count": c("variants")}),
        _group("delivery", {"shipping_fee": c("shipping_fee"), "fulfillment_type": c("fulfillment_type")}),
        _group("returns"),
        _group("marketing"),
        _group("brand"),
        _group("safety"),
        _group("related"),
        _group("review_section", {"rating_distribution": fields.star_histogram(c("stars_text"))}),
        F.struct("date_first_available").alias("listed"),
        F.struct(c("n_json_ld").alias("json_ld_count"), "has_twister_data", c("parent_input").alias("parent_asin")).alias("hidden"),
        _group("stock"),
        F.struct("bsr_main_rank", "bsr_main_category", "bsr_sub_rank", "bsr_sub_category").alias("ranks"),
        F.struct("item_weight", "item_dimensions", "country_of_origin").alias("physical"),
        fields.json_type(c("json_ld")).alias("json_ld_type"),
    )


#: The blocks that fields of the inventory are read from, those of ``GROUPS`` aside.
READ_FROM = {
    "core.brand_url": ("brand_url",), "core.has_brand_store": ("brand_url",), "core.asin": ("item_input",),
    "price.price": ("price_text",), "price.original_price": ("original_price",), "price.discount_pct": ("discount_text",),
    "ratings.rating": ("rating_text",), "ratings.bsr_raw": ("ranks_text",), "ratings.is_amazons_choice": ("badges",),
    "media.main_image_url": ("image_url",), "media.image_count": ("images",), "media.has_video": ("has_video",),
    "category.breadcrumbs": ("breadcrumbs",), "description.bullet_count": ("bullet_texts",),
    "description.bullets_sample": ("bullet_texts",), "description.has_description": ("description",),
    "attributes": ("attributes",), "overview": ("overview",), "variants.variant_dimensions": ("variant_labels",),
    "variants.variant_option_count": ("variants",), "delivery.shipping_fee": ("delivery_text",),
    "delivery.fulfillment_type": ("merchant_text", "offer_text"), "review_section.rating_distribution": ("stars_text",),
    "listed.date_first_available": ("rows",), "hidden.json_ld_count": ("n_json_ld",), "hidden.has_twister_data": ("has_twister_data",),
    "hidden.parent_asin": ("parent_input",), "ranks.bsr_main_rank": ("ranks_text",), "ranks.bsr_main_category": ("ranks_text",),
    "ranks.bsr_sub_rank": ("ranks_text",), "ranks.bsr_sub_category": ("ranks_text",), "physical.item_weight": ("rows",),
    "physical.item_dimensions": ("rows",), "physical.country_of_origin": ("rows",), "json_ld_type": ("json_ld",),
}


def inventory_part(pages: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(page_id, the named fields) of the inventory, as ``group.field``; only the blocks that they are read from are made."""
    specs = {f"{g}.{f}": spec for g, own in GROUPS.items() for f, spec in own.items()}
    ids = frozenset(i for n in names if n in specs for i in specs[n].lstrip("?").split())
    made = {b for n in names for b in (("blocks",) if n in specs else READ_FROM[n])}
    blocks = detail_blocks(pages, ("page_id",), tuple(made), ids)
    # the record's other fields, which nothing selects, are read from nulls
    absent = {f.name: F.lit(None).cast(f.dataType) for f in T.StructType.fromDDL(DETAIL_BLOCKS) if f.name not in made}
    return inventory(blocks.withColumns(absent)).select("page_id", *names)


def flat_probe(blocks: DataFrame) -> DataFrame:
    """One flat row for each page: the fields that a first look at a detail page asks for."""
    c = F.col
    attribute = lambda *keys: fields.first_value(list(keys), c("attributes"))
    size_keys = ("Package Dimensions", "Product Dimensions", "Item Dimensions L x W", "Item Dimensions LxWxH", "Item Dimensions")
    wanted = lambda t: ~t.contains("Make sure this")
    points = F.filter("bullet_texts", wanted)
    of = lambda group, *names: {n: GROUPS[group][n] for n in names}
    specs = (
        of("price", "coupon_text", "has_coupon") | of("ratings", "qa_count") | of("delivery", "seller_name", "availability")
        | of("marketing", "has_subscribe_save", "has_climate_pledge", "has_fbt", "has_comparison_table", "has_sponsored_section", "has_gift_option")
        | of("description", "has_aplus")
    )
    columns = {
        "title": c("title"),
        "brand_raw": block_text("bylineInfo"),
        "brand_url": c("brand_url"),
        "price": c("price_text"),
        "original_price": c("original_price"),
        "discount_pct": c("discount_text"),
        "rating": c("rating_text"),
        "review_count": c("review_text"),
        "main_image": c("image_url"),
        "image_count": c("images"),
        "has_video": c("has_video"),
        "breadcrumbs": c("breadcrumbs"),
        "bullet_point_count": F.size(points),
        "bullet_points_sample": F.slice(points, 1, 2),
        "details": F.map_filter("attributes", lambda k, _: ~k.contains("Customer Reviews")),
        "bsr": fields.sales_ranks_cut(c("ranks_text")),
        "asin": c("item_input"),
        "date_first_available": attribute("Date First Available"),
        "variant_types": c("variant_labels"),
        "variant_option_count": c("variants"),
        "buybox_info": c("buybox_texts"),
        "description_len": F.length(block_text("productDescription")),
        "dimensions": attribute(*size_keys),
        "weight": attribute("Item Weight"),
        "manufacturer": attribute("Manufacturer"),
        "country_of_origin": attribute("Country of Origin"),
        "has_brand_store": F.coalesce(c("brand_url").contains("/stores/"), F.lit(False)),
        "delivery_info": F.left(c("delivery_text"), F.lit(150)),
        "other_sellers_count": c("n_offers"),
        "new_used_offers": F.left(c("sellers_text"), F.lit(100)),
        "has_promotion": has_block("promoPriceBlockMessage_feature_div"),
        "has_return_policy": has_block(GROUPS["returns"]["return_policy"]),
    }
    columns |= {n: has_block(spec) if spec.startswith("?") else block_text(spec) for n, spec in specs.items()}
    return blocks.select("page_id", *[v.alias(k) for k, v in columns.items()])


# --- trees -------------------------------------------------------------------


def _class_part(name: str) -> Callable[[Element], bool]:
    def test(e: Element) -> bool:
        return name in e.get("class") and any(name in c for c in e.classes())

    test.holds = name
    return test


_is_group = is_tag("ul", where=_class_part("zg-browse-group"))
_is_root = is_tag("ul", where=_class_part("zg-browse-root"))
_is_selected = _class_part("zg-selected")
_CHILD_LINKS = [is_tag("a", where=lambda e, p=p: p in e.get("href")) for p in ("/gp/", "/zgbs/", "/zgns/", "")]
_CRUMB_BOX = has_id("wayfinding-breadcrumbs_feature_div")
_HEADING, _ROOT_BOX = is_tag("h1"), has_id("zg_browseRoot")


def _child_box(root: Element) -> Element | None:
    selected = root.find(_is_selected)
    if selected is None:
        groups = root.all(_is_group)
        return groups[-1] if groups else None
    item = selected
    while item is not None and item.tag != "li":
        item = item.parent
    siblings = [c for c in item.parent.content if isinstance(c, Element) and c.tag == "li"] if item is not None else []
    after = siblings[siblings.index(item) + 1 :] if item in siblings else []
    return after[0].find(_is_group) if after else None


def _sidebar(page: Element, _: str = "") -> Iterator[dict]:
    root = page.find(_is_root)
    box = _child_box(root) if root is not None else None
    for pos, item in enumerate(c for c in (box.content if box is not None else []) if isinstance(c, Element) and c.tag == "li"):
        if any("browse-up" in c for c in item.classes()):
            continue
        link = item.find(*_CHILD_LINKS)
        if link is not None:
            yield {"pos": pos, "name": link.text(""), "href": link.get("href")}


def sidebar_children(pages: DataFrame, domain: Column, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(pos, name, child_url, node_id, slug) of the child categories in a page's side bar, each URL once per page."""
    raw = _per_page(pages, "pos int, name string, href string", _sidebar, keep)
    clean = F.trim(fields.strip_marks(F.col("name")))
    rows = raw.withColumn("name", clean).where((F.col("name") != "") & (F.col("href") != "") & ~F.col("name").rlike(r"^\d+$"))
    rows = rows.withColumn("child_url", urls.normalize_url(urls.absolute_url(domain, F.col("href"))))
    return first_rows(rows, [keep[0], "child_url"], ["pos"]).select(
        *keep,
        "pos",
        "name",
        "child_url",
        urls.path_node_id(F.col("child_url")).alias("node_id"),
        F.coalesce(urls.chart_slug(F.col("child_url")), F.lit("")).alias("slug"),
    )


def chart_children(pages: DataFrame, domain: Column, key: str = "node") -> DataFrame:
    """(key, node_id, name, child_url, slug, page_no): children in the side bars of a node's chart pages, each id once.

    ``pages`` has key (the node whose pages they are) and page_no besides
    page_id, url and html; a child without an id is left out, of equal ids the
    one on the first page and place stays.
    """
    rows = sidebar_children(pages, domain, ("page_id", key, "page_no")).where("node_id is not null")
    first = first_rows(rows, [key, "node_id"], ["page_no", "pos", "page_id"])
    return first.select(key, "node_id", "name", "child_url", "slug", "page_no")


def _crumbs(page: Element, _: str = "") -> Iterator[dict]:
    box = page.find(_CRUMB_BOX)
    for pos, a in enumerate(box.all(_A) if box is not None else []):
        yield {"pos": pos, "name": a.text(""), "href": a.get("href")}


def breadcrumb_rows(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(pos, name, node_id) of a page's breadcrumb links in order; links without a name or id are left out."""
    raw = _per_page(pages, "pos int, name string, href string", _crumbs, keep)
    rows = raw.withColumn("node_id", urls.query_node_id(F.col("href"))).where("name <> '' and node_id is not null")
    return rows.select(*keep, "pos", "name", "node_id")


def _root_links(page: Element, _: str = "") -> Iterator[dict]:
    root = page.find(_is_root, _ROOT_BOX)
    for a in root.all(_LINK) if root is not None else []:
        yield {"href": a.get("href")}


def root_slugs(pages: DataFrame) -> DataFrame:
    """Distinct slugs of the category links of a root directory page, with the skip flag."""
    from shelflight.operators.filters import is_skipped


    raw = _per_page(pages, "href string", _root_links, ("page_id",))
    slugs = raw.select(urls.chart_slug(F.col("href")).alias("slug")).where("slug is not null").distinct()
    return slugs.withColumn("skipped", is_skipped(F.col("slug")))


def _headings(page: Element, _: str = "") -> Iterator[dict]:
    selected = page.find(_is_selected)
    yield {"selected": _text(selected), "heading": _text(page.find(_HEADING))}


_headings.first_of = (_is_selected, _HEADING)


def root_name(pages: DataFrame) -> DataFrame:
    """(page_id, name): localised name of a root page, by its selected entry, else by its heading."""


    raw = _per_page(pages, "selected string, heading string", _headings, ("page_id",))
    name = F.coalesce(F.nullif(F.trim("selected"), F.lit("")), fields.heading_name(F.col("heading"), F.col("heading")))
    return raw.select("page_id", name.alias("name"))


def _links(page: Element, _: str = "") -> Iterator[dict]:
    for pos, a in enumerate(page.all(_LINK)):
        yield {"pos": pos, "href": a.get("href"), "name": a.text("")}


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, name) of every link of a page."""
    return _per_page(pages, "pos int, href string, name string", _links, ("page_id",))


def page_items(pages: DataFrame, n: int = 10) -> DataFrame:
    """(page_id, pos, asin) of the first ``n`` distinct item ids of a page: native, no parser."""
    return pages.select("page_id", F.posexplode(urls.first_items(F.col("html"), n)).alias("pos", "asin"))


#: Raw texts of each kind of page: the function over one page, and its columns.
EXTRACTORS = {
    "page_links": (_links, "pos int, href string, name string"),
    "page_crumbs": (_crumbs, "pos int, name string, href string"),
    "page_cards": (_chart, CARD_FIELDS),
    "page_movers": (_movers, MOVER_FIELDS),
    "page_results": (_results, RESULT_FIELDS),
    "page_blocks": (_details, DETAIL_BLOCKS),
    "page_children": (_sidebar, "pos int, name string, href string"),
    "page_root_links": (_root_links, "href string"),
    "page_headings": (_headings, "selected string, heading string"),
}


def _table_function(make: Callable[[Element, str], Iterator[dict]], schema: str):
    from pyspark.sql.functions import udtf

    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", schema)]

    class Rows:
        def eval(self, html: str):
            for found in _found(make, html):
                yield tuple(found.get(n) for n in names)

    return udtf(Rows, returnType=schema)


def _pages_function(make: Callable[[Element, str], Iterator[dict]], schema: str):
    """A table function over whole pages: page_id, url and the extractor's columns; Arrow batches in and out."""
    from pyspark.sql.functions import arrow_udtf

    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", schema)]
    whole = f"page_id long, url string, {schema}"
    arrow = to_arrow_schema(T.StructType.fromDDL(whole))

    class Rows:
        def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
            given = [pages.column(pages.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html")]
            out: list = []
            for page_id, url, html in zip(*given):
                out += [{"page_id": page_id, "url": url} | {n: found.get(n) for n in names} for found in _found(make, html)]
                if len(out) >= ROWS_AT_ONCE:
                    yield pa.Table.from_pylist(out, arrow)
                    out = []
            if out:
                yield pa.Table.from_pylist(out, arrow)

    return arrow_udtf(Rows, returnType=whole)


#: Extractors whose columns are plain values, and so may also be table functions over pages.
PAGE_FUNCTIONS = {"links_of": "page_links", "crumbs_of": "page_crumbs", "cards_of": "page_cards", "results_of": "page_results",
                  "children_of": "page_children", "headings_of": "page_headings"}


def register_table_functions(spark) -> None:
    """SQL table functions of the extractors.

    For LATERAL joins, each with a page's HTML as argument: page_links, page_crumbs,
    page_cards, page_movers, page_results, page_blocks, page_children,
    page_root_links and page_headings. Over tables of pages (page_id, url, html and
    more), a batch at a time: links_of, crumbs_of, cards_of, results_of, children_of
    and headings_of, as in ``cards_of(TABLE(pages) PARTITION BY page_id)``; without
    PARTITION BY pages are read where they lie. All give raw texts; typed values come
    from the functions over them.
    """
    for name, (make, schema) in EXTRACTORS.items():
        spark.udtf.register(name, _table_function(make, schema))
    for name, own in PAGE_FUNCTIONS.items():
        spark.udtf.register(name, _pages_function(*EXTRACTORS[own]))
