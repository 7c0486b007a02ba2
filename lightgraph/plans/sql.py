"""DuckDB SQL for the queries: graphs as common table expressions, and propagation unrolled by depth."""

from __future__ import annotations

from ..functions.lookups import INTENT_BINS, INTENT_PHRASES, OTHER_CONFIDENCE, OTHER_INTENT, PROPERTY_BINS, RELATED_BINS, RELATION_BINS, similarity_of
from ..params import LightParams
from .graphs import KEYS, SPAN, TYPES


def _id(place: int, key: str) -> str:
    return f"{place}::BIGINT * {SPAN} + {key}"


def _numbered(rows: str) -> str:
    return f"SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst, bin) - 1)::INTEGER AS pos, attenuation, bin FROM ({rows})"


def star() -> str:
    nodes = " UNION ALL ".join(f"SELECT {_id(i, k)} AS node_id, {la} AS label, '{t}' AS node_type, {i} AS room, 1.0::DOUBLE AS luminance, 1.0::DOUBLE AS reflection, 1.0::DOUBLE AS refraction FROM {t}" for i, (t, k, la) in enumerate(TYPES))
    edges = " UNION ALL ".join(f"SELECT {_id(a, s)} AS src, {_id(b, d)} AS dst, 0.1::DOUBLE AS attenuation, {n} AS bin FROM {t}" for t, a, s, b, d, n in KEYS)
    return f"nodes AS ({nodes}), edges AS ({_numbered(edges)})"


def dir_lum(prop: str, peak: float = 2.0, falloff: float = 0.8) -> str:
    """CASE over properties of literal lists."""
    lists = {p: [peak * max(0.0, 1 - min(abs(b - at), 16 - abs(b - at)) / 16 * falloff) for b in range(16)] for p, at in PROPERTY_BINS.items()}
    return f"CASE {prop} " + " ".join(f"WHEN '{p}' THEN {v}::DOUBLE[]" for p, v in lists.items()) + " END"


def nation(plain: bool = True) -> str:
    seg = "CASE WHEN c_custkey % 2 = 0 THEN 'OppositeOf' ELSE 'SimilarTo' END"
    rows = (
        f"SELECT {_id(0, 'r_regionkey')} AS node_id, 'Contains' AS prop, r_regionkey AS room FROM region UNION ALL "
        f"SELECT {_id(1, 'n_nationkey')}, 'IsA', n_regionkey FROM nation UNION ALL "
        f"SELECT {_id(2, 'c_custkey')}, {seg}, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey"
    )
    prop = "NULL::VARCHAR" if plain else "prop"
    nodes = f"SELECT node_id, {prop} AS prop, {dir_lum('prop')} AS dir_lum, room, 1.0::DOUBLE AS luminance, 1.0::DOUBLE AS reflection, 1.0::DOUBLE AS refraction FROM ({rows})"
    edges = " UNION ALL ".join(f"SELECT {_id(a, s)} AS src, {_id(b, d)} AS dst, 0.1::DOUBLE AS attenuation, {n} AS bin FROM {t}" for t, a, s, b, d, n in KEYS[:3])
    return f"nodes AS ({nodes}), edges AS ({_numbered(edges)})"


def ring(n: int = 1000, out: int = 8, base: float = 0.1, step: float = 0.02, luminance: float = 2.0) -> str:
    nodes = f"SELECT i::BIGINT AS node_id, NULL::VARCHAR AS prop, {luminance}::DOUBLE AS luminance, 1.0::DOUBLE AS reflection, 1.0::DOUBLE AS refraction, 0 AS room FROM range({n}) t(i)"
    edges = f"SELECT i::BIGINT AS src, ((i + j) % {n})::BIGINT AS dst, (j - 1)::INTEGER AS pos, {base}::DOUBLE + {step}::DOUBLE * j AS attenuation, ((i + j) % 16)::INTEGER AS bin FROM range({n}) t(i), range(1, {out + 1}) u(j)"
    return f"nodes AS ({nodes}), edges AS ({edges})"


def vectors(k: int = 3) -> str:
    hops = (1, 7, 31)[:k]
    links = " UNION ALL ".join(f"SELECT vec_id AS src, vec_id + {h} AS dst, {i} AS pos, 0.1::DOUBLE AS attenuation, (label + {4 * i}) % 16 AS bin FROM embeddings" for i, h in enumerate(hops))
    nodes = "SELECT vec_id AS node_id, NULL::VARCHAR AS prop, label AS room, 1.0::DOUBLE AS luminance, 1.0::DOUBLE AS reflection, 1.0::DOUBLE AS refraction FROM embeddings"
    return f"nodes AS ({nodes}), edges AS (SELECT * FROM ({links}) WHERE dst IN (SELECT vec_id FROM embeddings))"


def turn(a: str, b: str, bins: int = 16) -> str:
    return f"(least(abs({a} - {b}), {bins} - abs({a} - {b})) / {bins}.0::DOUBLE)"


def light(sources: str, p: LightParams = LightParams(), mode: str = "ordered", gate: bool = False, pvs: bool = False) -> str:
    """CTEs up to `lit` (qid, node_id, intensity). sources: rows (qid, node_id, bin). pvs: a CTE of that name prunes."""
    if mode == "maxbin":
        seed = f"SELECT s.qid, s.node_id AS u, s.bin % {p.bins} AS bin, greatest(n.luminance, 1.0::DOUBLE) AS x, [s.bin] AS seq FROM sources s JOIN nodes n USING (node_id)"
    elif mode == "levelmax":
        seed = "SELECT s.qid, s.node_id AS u, s.bin, greatest(1.0::DOUBLE, list_avg(n.dir_lum)) AS x, [s.bin] AS seq FROM sources s JOIN nodes n USING (node_id)"
    elif gate:
        seed = f"SELECT qid, u, i - 1 AS bin, x, [i - 1] AS seq FROM (SELECT s.qid, s.node_id AS u, unnest(range(1, 17)) AS i, unnest(n.dir_lum) AS x FROM sources s JOIN nodes n USING (node_id) WHERE n.prop IS NOT NULL) WHERE x > {p.min_intensity}"
    else:
        seed = "SELECT s.qid, s.node_id AS u, s.bin, greatest(n.luminance, 1.0::DOUBLE) AS x, [s.bin] AS seq FROM sources s JOIN nodes n USING (node_id)"
    out = [f"sources AS ({sources})", f"f0 AS ({seed})", "b0 AS (SELECT qid, u AS v, bin, x FROM f0)"]
    bad = " OR ".join(f"(a.prop = '{x}' AND z.prop = '{y}')" for x in PROPERTY_BINS for y in PROPERTY_BINS if similarity_of(x, y) < 0.2)
    for d in range(1, p.max_depth + 1):
        x = f"f.x * (a.reflection * (1.0::DOUBLE - e.attenuation)) * exp(-{p.k}::DOUBLE * a.refraction * {turn('f.bin', 'e.bin', p.bins)} * {turn('f.bin', 'e.bin', p.bins)})"
        more = " JOIN nodes z ON z.node_id = e.dst" if gate or pvs else ""
        test = (f" AND NOT coalesce({bad}, false)" if gate else "") + (" AND EXISTS (SELECT 1 FROM pvs WHERE from_room = a.room AND pvs.bin = f.bin AND to_room = z.room)" if pvs else "")
        made = f"SELECT f.qid, e.dst AS v, e.bin, {x} AS x, list_append(f.seq, e.pos) AS seq FROM f{d - 1} f JOIN nodes a ON a.node_id = f.u JOIN edges e ON e.src = f.u{more} WHERE f.x >= {p.min_intensity}{test}"
        made = f"SELECT * FROM ({made}) WHERE x >= {p.min_intensity}"
        if mode == "maxbin":
            made = f"SELECT qid, v, bin, max(x) AS x, NULL::INTEGER[] AS seq FROM ({made}) GROUP BY ALL"
        out.append(f"c{d} AS MATERIALIZED ({made})")
        out.append(f"b{d} AS (SELECT * FROM b{d - 1} UNION ALL SELECT qid, v, bin, x FROM c{d})")
        if d < p.max_depth:
            if mode == "levelmax":
                nxt = f"SELECT qid, v AS u, bin, max(x) AS x, [0] AS seq FROM c{d} GROUP BY ALL"
            else:
                before = "max(x) OVER (PARTITION BY qid, v, bin ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" if mode == "ordered" else "NULL::DOUBLE"
                nxt = (
                    f"SELECT c.qid, c.v AS u, c.bin, c.x, c.seq FROM (SELECT *, {before} AS earlier FROM c{d}) c LEFT JOIN (SELECT qid, v, bin, max(x) AS best FROM b{d - 1} GROUP BY ALL) b "
                    f"ON b.qid = c.qid AND b.v = c.v AND b.bin = c.bin WHERE c.x > coalesce(c.earlier, 0) AND c.x > coalesce(b.best, 0)"
                )
            out.append(f"f{d} AS MATERIALIZED ({nxt})")
    every = f"b{p.max_depth}"
    if mode == "maxbin":
        every = f"(SELECT qid, v, bin, max(x) AS x FROM {every} GROUP BY ALL)"
    out.append(f"lit AS (SELECT qid, v AS node_id, sum(x) AS intensity FROM {every} GROUP BY ALL)")
    return ", ".join(out)


def values(rows: list[tuple], names: str) -> str:
    first = names.split(", ")[0]
    body = ", ".join("(" + ", ".join(f"{v}::BIGINT" if i == 0 or (i == 1 and isinstance(v, int)) else (f"{v}::DOUBLE" if isinstance(v, float) else str(v)) for i, v in enumerate(r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({names})" if first else ""


def case(key: str, table: dict, default: str = "NULL") -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in table.items()) + f" ELSE {default} END"


def relation_bin(column: str) -> str:
    return case(f"replace(replace(lower({column}), ' ', '_'), '-', '_')", RELATION_BINS, "2")


def intent(text: str) -> str:
    tests = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{p}')" for p in ps) + f" THEN '{name}'" for name, ps in INTENT_PHRASES.items())
    return f"CASE {tests} ELSE '{OTHER_INTENT}' END"


def intent_counts(text: str) -> str:
    """A list of structs (n, at, intent)."""
    return "[" + ", ".join("{'n': " + " + ".join(f"contains(lower({text}), '{p}')::INTEGER" for p in ps) + f", 'at': {i}, 'intent': '{name}'}}" for i, (name, ps) in enumerate(INTENT_PHRASES.items())) + "]"


def intent_confidence(text: str) -> str:
    best = f"list_max({intent_counts(text)})"
    return f"CASE WHEN {best}.n = 0 THEN '{OTHER_INTENT}' ELSE {best}.intent END AS intent, CASE WHEN {best}.n = 0 THEN {OTHER_CONFIDENCE}::DOUBLE ELSE least({best}.n / 3.0::DOUBLE, 1.0::DOUBLE) END AS confidence"


def intent_bins(name: str) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {RELATED_BINS.get(k, [b])}" for k, b in INTENT_BINS.items()) + " END"


COS = "list_cosine_similarity"
