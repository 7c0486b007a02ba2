"""Fixed vocabularies: relationship properties, relations, intents. Small enough to be map literals in a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Relationship property -> direction bin.
PROPERTY_BINS = {
    "IsA": 0, "RelatedTo": 2, "Causes": 4, "Contains": 6, "PartOf": 8, "SimilarTo": 10, "OppositeOf": 12, "Enables": 14, "Requires": 1, "ConflictsWith": 15,
}
# Similarity of property pairs, symmetric; 1 for equal ones, OTHER_SIMILARITY for the rest.
PROPERTY_SIMILARITIES = {
    ("IsA", "PartOf"): 0.7, ("Contains", "PartOf"): 0.8, ("Causes", "Enables"): 0.6, ("Requires", "Enables"): 0.5, ("RelatedTo", "SimilarTo"): 0.7,
    ("IsA", "OppositeOf"): 0.1, ("Causes", "ConflictsWith"): 0.2, ("Enables", "ConflictsWith"): 0.2,
}
OTHER_SIMILARITY = 0.3
#: Below this similarity of two nodes' properties no intensity passes.
LEAST_SIMILARITY = 0.2

# Normalised relation -> bin, the general table.
RELATION_BINS = {
    "is_a": 0, "type_of": 0, "instance_of": 0, "isa": 0, "typeof": 0, "instanceof": 0,
    "requires": 1, "depends_on": 1, "needs": 1, "dependson": 1, "prerequisite": 1,
    "related_to": 2, "associated_with": 2, "relatedto": 2, "associatedwith": 2, "about": 2,
    "causes": 4, "leads_to": 4, "results_in": 4, "leadsto": 4, "resultsin": 4, "produces": 4,
    "contains": 6, "has": 6, "includes": 6, "comprises": 6,
    "part_of": 8, "belongs_to": 8, "member_of": 8, "partof": 8, "belongsto": 8, "memberof": 8,
    "similar_to": 10, "like": 10, "resembles": 10, "similarto": 10, "analogous_to": 10, "analogousto": 10,
    "opposite_of": 12, "contrasts_with": 12, "oppositeof": 12, "contrastswith": 12, "antonym_of": 12, "antonymof": 12,
    "enables": 14, "allows": 14, "supports": 14, "facilitates": 14,
    "conflicts_with": 15, "incompatible": 15, "conflictswith": 15, "incompatible_with": 15, "incompatiblewith": 15,
}
# Relation -> bin as the label builder takes them, exact spelling.
BUILDER_BINS = {
    "followed_by": 4, "preceded_by": 8, "owns_vehicle": 6, "serviced_at": 6, "assigned_to": 6, "belongs_to": 8, "same_vehicle": 10, "same_customer": 10,
    "same_code": 10, "is_a": 0, "type_of": 0, "has_code": 0, "related_to": 2, "co_occurs": 2, "resolves": 14, "warns_about": 4, "declined": 12,
    "prefers_make": 10, "prefers_type": 10, "purchased": 4, "interested_in": 4,
}
DEFAULT_BIN = 2

# The phrases of each intent, in the order in which intents are tried.
INTENT_PHRASES = {
    "Definition": ["what is", "what are", "define", "definition", "meaning of", "explain what", "describe what", "who is", "who are"],
    "Causation": ["why", "cause", "causes", "caused by", "reason", "because", "leads to", "results in", "effect of", "consequence"],
    "Requirements": ["need", "needs", "require", "requires", "required", "prerequisite", "dependency", "dependencies", "how to", "steps to"],
    "Conflict": ["conflict", "incompatible", "contradiction", "clash", "mutually exclusive", "cannot", "prevents"],
    "Contrast": ["opposite", "different from", "contrast", "versus", "vs", "distinction", "difference between", "unlike"],
    "Composition": ["contains", "inside", "within", "components", "parts of", "made of", "consists of", "includes", "has"],
    "Membership": ["part of", "belongs to", "member of", "category", "type of", "classified as", "falls under", "included in"],
    "Capability": ["can", "able to", "capable of", "enables", "allows", "makes possible", "supports", "provides"],
    "Similarity": ["similar", "like", "resembles", "analogous", "comparable", "related to", "alternatives", "other options"],
}
OTHER_INTENT, OTHER_CONFIDENCE = "Association", 0.3
# Intent -> bin, related bins (its own where not listed), property.
INTENT_BINS = {"Definition": 0, "Requirements": 1, "Association": 2, "Causation": 4, "Composition": 6, "Membership": 8, "Similarity": 10, "Contrast": 12, "Capability": 14, "Conflict": 15, "MultiHop": 2}
RELATED_BINS = {"Definition": [0, 8], "Causation": [4, 14, 1], "Composition": [6, 8], "Similarity": [10, 2], "MultiHop": [0, 2, 4, 6, 8, 10]}
INTENT_PROPERTIES = {
    "Definition": "IsA", "Requirements": "Requires", "Association": "RelatedTo", "Causation": "Causes", "Composition": "Contains", "Membership": "PartOf",
    "Similarity": "SimilarTo", "Contrast": "OppositeOf", "Capability": "Enables", "Conflict": "ConflictsWith", "MultiHop": "RelatedTo",
}


def bin_names() -> dict[int, str]:
    """Bin -> canonical relation, the inverse of PROPERTY_BINS."""
    return {b: p for p, b in PROPERTY_BINS.items()}


def similarity_of(a: str, b: str) -> float:
    return 1.0 if a == b else PROPERTY_SIMILARITIES.get((a, b), PROPERTY_SIMILARITIES.get((b, a), OTHER_SIMILARITY))


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def lookup(values: dict, key: Column) -> Column:
    """The value of a key, null where there is none."""
    return F.try_element_at(literal_map(values), key)


def property_bin(prop: Column) -> Column:
    return lookup(PROPERTY_BINS, prop)


def property_count() -> int:
    return len(PROPERTY_BINS)


def property_place(prop: str) -> int:
    """Where a property stands among all, from 0."""
    return list(PROPERTY_BINS).index(prop)


def property_similarity(a: Column, b: Column) -> Column:
    """Similarity of two properties; null if either is null or unknown."""
    both = {f"{x}|{y}": similarity_of(x, y) for x in PROPERTY_BINS for y in PROPERTY_BINS}
    return lookup(both, F.concat_ws("|", a, b))


def property_pairs(spark: SparkSession) -> DataFrame:
    """(a, b, similarity, distance) of all pairs of properties."""
    rows = [(x, y, similarity_of(x, y), min(abs(p - q), 16 - abs(p - q))) for x, p in PROPERTY_BINS.items() for y, q in PROPERTY_BINS.items()]
    return spark.createDataFrame(rows, "a string, b string, similarity double, distance int")


def normalize_relation(relation: Column) -> Column:
    return F.translate(F.lower(relation), " -", "__")


def relation_bin(relation: Column, default: int = DEFAULT_BIN) -> Column:
    return F.coalesce(lookup(RELATION_BINS, normalize_relation(relation)), F.lit(default))


def builder_bin(relation: Column) -> Column:
    return F.coalesce(lookup(BUILDER_BINS, relation), F.lit(DEFAULT_BIN))


def relation_name(bin_: Column) -> Column:
    return lookup(bin_names(), bin_)


def intent(text: Column) -> Column:
    """The first intent, in order, one of whose phrases the lower-cased text contains."""
    low, out = F.lower(text), None
    for name, phrases in INTENT_PHRASES.items():
        hit = low.contains(phrases[0])
        for p in phrases[1:]:
            hit |= low.contains(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER_INTENT)


def intent_confidence(text: Column) -> Column:
    """struct(intent, confidence): most distinct phrases, ties to the later intent; a third a phrase, 1 at most."""
    low = F.lower(text)
    counts = [F.struct(sum((low.contains(p).cast("int") for p in phrases), F.lit(0)).alias("n"), F.lit(at).alias("at"), F.lit(name).alias("intent")) for at, (name, phrases) in enumerate(INTENT_PHRASES.items())]
    best = F.array_max(F.array(*counts))
    none = best["n"] == 0
    return F.struct(
        F.when(none, OTHER_INTENT).otherwise(best["intent"]).alias("intent"),
        F.when(none, F.lit(OTHER_CONFIDENCE)).otherwise(F.least(best["n"] / F.lit(3.0), F.lit(1.0))).alias("confidence"),
    )


def intent_bin(name: Column) -> Column:
    return lookup(INTENT_BINS, name)


def intent_bins(name: Column) -> Column:
    """The related bins of an intent, as an array."""
    return F.coalesce(F.try_element_at(F.create_map(*(x for k, v in RELATED_BINS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), name), F.array(intent_bin(name)))


def intent_property(name: Column) -> Column:
    return lookup(INTENT_PROPERTIES, name)


def related_bins_of(name: str) -> list[int]:
    return RELATED_BINS.get(name, [INTENT_BINS[name]])


def parse_start(text: Column) -> Column:
    """The plain query parser: struct(node_id, bin) 0, 0 if the text speaks of a start or beginning, else null."""
    low = F.lower(text)
    return F.when(low.contains("start") | low.contains("beginning"), F.struct(F.lit(0).cast("long").alias("node_id"), F.lit(0).alias("bin")))
