"""Field declarations: what to extract, and how values are cleaned and typed."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from quarry.functions.css import compile_selector
from quarry.functions.transforms import Transform
from quarry.functions.xpath import compile_xpath


class Kind(Enum):
    CSS = "css"
    REGEX = "regex"  # of the text of the first match
    XPATH = "xpath"
    JSON_LD = "json-ld"  # a dotted path
    MAIN_CONTENT = "main-content"


@dataclass(frozen=True)
class FieldSpec:
    """How one field is found.  ``attribute`` is an attribute's name, or the pattern of a REGEX field."""

    selector: str = ""
    kind: Kind = Kind.CSS
    attribute: str | None = None
    description: str | None = None
    required: bool = False
    fallbacks: tuple[str, ...] = ()
    transforms: tuple[Transform, ...] = ()
    type: str = "string"  # string, decimal, double, float, int, long, datetime, url, or an enumeration "a|b|c"

    def check(self) -> FieldSpec:
        """Raises ValueError now rather than in a task where a CSS selector can't be compiled; XPath errors are null values."""
        if self.kind in (Kind.CSS, Kind.REGEX):
            for s in (self.selector, *self.fallbacks):
                compile_selector(s)
        if self.kind is Kind.XPATH:
            for s in (self.selector, *self.fallbacks):
                try:
                    compile_xpath(s)
                except ValueError:
                    pass
        return self


Fields = dict[str, FieldSpec]


def json_ld_fields(paths: dict[str, str]) -> Fields:
    return {name: FieldSpec(path, Kind.JSON_LD) for name, path in paths.items()}


# The paths of two schema.org types.
PRODUCT = json_ld_fields(
    {
        "Name": "name", "Sku": "sku", "Description": "description", "Brand": "brand.name", "Price": "offers.price", "Currency": "offers.priceCurrency",
        "Availability": "offers.availability", "Image": "image", "RatingValue": "aggregateRating.ratingValue", "ReviewCount": "aggregateRating.reviewCount",
    }
)
ARTICLE = json_ld_fields(
    {"Headline": "headline", "Author": "author.name", "DatePublished": "datePublished", "DateModified": "dateModified", "Description": "description", "Publisher": "publisher.name"}
)


def harvest_field(selector: str = "", **how):
    """A dataclass field that carries its FieldSpec; see ``fields_of``."""
    return field(default=None, metadata={"spec": FieldSpec(selector, **how)})


def fields_of(cls: type) -> Fields:
    """The specs of a dataclass declared with ``harvest_field``, in order."""
    return {name: f.metadata["spec"] for name, f in cls.__dataclass_fields__.items() if "spec" in f.metadata}
