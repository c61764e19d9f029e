"""The five text checks as column expressions.

Term lists are parameters (:class:`Lexicon`). Terms are matched as substrings of
the lower-cased text, or as whole words with ``word_boundary``. Every term is one
plain ``contains`` on a shared lower-cased column, which stays inside generated
code; nothing here needs a UDF, so the checks also run on a stream.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

# Term lists of the dermoscopy gate.
CLASS_KEYWORDS = {
    "mel": ["melanoma", "pigment", "asymmetry", "border", "atypical", "nevus", "dermoscopic"],
    "melanoma": ["melanoma", "pigment", "asymmetry", "border", "atypical", "nevus", "dermoscopic"],
    "nv": ["nevus", "nevi", "melanocytic", "pigment", "benign", "regular", "symmetric"],
    "melanocytic nevus": ["nevus", "nevi", "melanocytic", "pigment", "benign", "regular"],
    "bcc": ["basal cell", "carcinoma", "pearlescent", "telangiectasia", "nodular", "ulcer"],
    "basal cell carcinoma": ["basal cell", "carcinoma", "pearlescent", "telangiectasia"],
    "akiec": ["actinic", "keratosis", "bowen", "squamous", "scaly", "hyperkeratotic"],
    "bkl": ["keratosis", "seborrheic", "benign", "pigmented", "dermatosis"],
    "df": ["dermatofibroma", "fibrous", "dimple", "central", "papule"],
    "vasc": ["vascular", "angioma", "cherry", "hemangioma", "blood", "vessel"],
    "scc": ["squamous", "cell", "carcinoma", "keratinizing", "ulcerated"],
    "ak": ["actinic", "keratosis", "scaly", "rough", "solar"],
}
DEFAULT_KEYWORDS = ["lesion", "skin", "dermoscopic"]
EXPECTED_KEYWORDS = {
    "akiec": ["actinic", "keratosis", "bowen", "scaly", "erythematous", "precancerous"],
    "bcc": ["basal cell", "pearly", "translucent", "telangiectasia", "rolled border"],
    "bkl": ["seborrheic", "keratosis", "benign", "waxy", "stuck-on"],
    "df": ["dermatofibroma", "fibrous", "dimple sign", "firm", "papule"],
    "mel": ["melanoma", "asymmetry", "irregular border", "pigment network", "blue-white"],
    "nv": ["nevus", "mole", "symmetric", "regular", "benign", "pigment network"],
    "vasc": ["vascular", "angioma", "cherry", "red", "lacuna", "blood vessel"],
}
INDETERMINATE_PHRASES = [
    "indeterminate", "cannot be determined", "unable to identify", "not visible",
    "insufficient resolution", "too low to assess", "cannot clearly see", "features are unclear",
]
REGION_TERMS = {
    "upper": ["upper", "top", "superior"],
    "lower": ["lower", "bottom", "inferior"],
    "left": ["left", "lateral left"],
    "right": ["right", "lateral right"],
    "center": ["center", "central", "middle", "core"],
    "diffuse": ["diffuse", "widespread", "throughout", "entire", "broadly"],
}
OPPOSITE_REGION = {"upper": "lower", "lower": "upper", "left": "right", "right": "left"}
HEDGES = [
    "consistent with", "suggestive of", "characteristic of", "may represent", "features of", "indicative of",
    "correlate", "biopsy", "clinical", "recommend", "should be considered", "differential",
]
DEFINITIVE_PHRASES = [
    "this is definitely", "this is certainly", "i diagnose", "the diagnosis is confirmed",
    "no doubt", "without question",
]
# Status texts of the region and language checks.
NO_REGION = "No spatial region in metadata, assuming pass"
ANY_REGION = "diffuse activation: any spatial reference acceptable"
NO_CLAIMS = "no spatial claims in text"
ALIGNED = "spatial references aligned"
CLASH = ('Text says "', '" but Grad-CAM shows "', '"')
TOO_DEFINITIVE = "contains definitive diagnostic language"
NO_HEDGE = "missing hedging/safety language"
APPROPRIATE = "appropriate clinical language"


@dataclass(frozen=True)
class Lexicon:
    """Term lists and bounds of the gate."""

    keywords: Mapping[str, Sequence[str]] = field(default_factory=lambda: CLASS_KEYWORDS)
    default_keywords: Sequence[str] = tuple(DEFAULT_KEYWORDS)
    min_keywords: int = 2
    reject: Sequence[str] = tuple(INDETERMINATE_PHRASES)
    regions: Mapping[str, Sequence[str]] = field(default_factory=lambda: REGION_TERMS)
    hedges: Sequence[str] = tuple(HEDGES)
    definitive: Sequence[str] = tuple(DEFINITIVE_PHRASES)
    min_words: int = 60
    max_words: int = 200
    word_boundary: bool = False


def mentions(lowered: Column, term: str, word_boundary: bool = False) -> Column:
    """Does the lower-cased text hold the term?"""
    term = term.lower()
    if word_boundary:
        return lowered.rlike(rf"(?U)\b{re.escape(term)}\b")
    return F.contains(lowered, F.lit(term))


def any_of(lowered: Column, terms: Sequence[str], word_boundary: bool = False) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | mentions(lowered, term, word_boundary)
    return found


def matched_terms(lowered: Column, terms: Sequence[str], word_boundary: bool = False) -> Column:
    """Terms found, in list order."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(mentions(lowered, t, word_boundary), F.lit(t)) for t in terms]))


def matched_keywords(lowered: Column, label: Column, lexicon: Lexicon) -> Column:
    """Keywords of the class found in the text; unknown classes use the default list."""
    key = F.lower(F.trim(label))
    result = F
    for name, terms in lexicon.keywords.items():
        result = result.when(key == name, matched_terms(lowered, terms, lexicon.word_boundary))
    return result.otherwise(matched_terms(lowered, lexicon.default_keywords, lexicon.word_boundary))


def matched_listed_keywords(lowered: Column, listed: Column) -> Column:
    """Keywords of an explicit per-row list found in the text (substrings)."""
    return F.filter(listed, lambda k: F.contains(lowered, F.lower(k)))


def expected_keywords(label: Column, lexicon: Lexicon) -> Column:
    """The list in force for a class, for reports."""
    key = F.lower(F.trim(label))
    result = F
    for name, terms in lexicon.keywords.items():
        result = result.when(key == name, F.array(*[F.lit(t) for t in terms]))
    return result.otherwise(F.array(*[F.lit(t) for t in lexicon.default_keywords]))


def first_phrase(lowered: Column, phrases: Sequence[str], word_boundary: bool = False) -> Column:
    """First listed phrase found, else NULL."""
    return F.coalesce(*[
        F.when(mentions(lowered, p, word_boundary), F.lit(p)) for p in phrases
    ], F.lit(None).cast("string"))


def named_regions(lowered: Column, lexicon: Lexicon) -> Column:
    """Regions the text speaks of, in lexicon order."""
    return F.array_compact(F.array(*[
        F.when(any_of(lowered, terms, lexicon.word_boundary), F.lit(region))
        for region, terms in lexicon.regions.items()
    ]))


def region_conflicts(lowered: Column, focus: Column, lexicon: Lexicon) -> Column:
    """Regions named in the text whose opposite, but not themselves, are in the focus region."""
    parts = F.split(focus, "-")
    cases = [
        F.when(
            any_of(lowered, lexicon.regions.get(region, ()), lexicon.word_boundary)
            & F.array_contains(parts, F.lit(opposite)) & ~F.array_contains(parts, F.lit(region)),
            F.lit(region),
        )
        for region, opposite in OPPOSITE_REGION.items()
    ]
    found = F.array_compact(F.array(*cases))
    return F.when(focus.isNull() | (focus == "diffuse"), F.array().cast("array<string>")).otherwise(found)


def spatial_status(conflicts: Column, regions: Column, focus: Column) -> Column:
    """Reason text of the region check."""
    clash = F.concat_ws("; ", F.transform(
        conflicts, lambda r: F.concat(F.lit(CLASH[0]), r, F.lit(CLASH[1]), focus, F.lit(CLASH[2]))
    ))
    return (
        F.when(focus.isNull(), F.lit(NO_REGION))
        .when(focus == "diffuse", F.lit(ANY_REGION))
        .when(F.size(regions) == 0, F.lit(NO_CLAIMS))
        .when(F.size(conflicts) > 0, clash)
        .otherwise(F.lit(ALIGNED))
    )


def word_count(text: Column) -> Column:
    """Words between Unicode white space (and the ASCII separators 1C-1F); 0 for blank text."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def safety_problem(lowered: Column, lexicon: Lexicon) -> Column:
    """NULL if the text hedges and claims nothing definitive, else what is wrong."""
    return (
        F.when(any_of(lowered, lexicon.definitive, lexicon.word_boundary), F.lit(TOO_DEFINITIVE))
        .when(~any_of(lowered, lexicon.hedges, lexicon.word_boundary), F.lit(NO_HEDGE))
    )
