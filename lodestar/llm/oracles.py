"""SQL twins of those operators that SQL can express, for DuckDB."""

from __future__ import annotations

from lodestar.llm import fingerprint, secret_scan, sharding, url_filter, winnow
from lodestar.llm.common import LOWER, UPPER


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets_sql() -> str:
    """Spans by lengths: what a pattern splits a text into, and its matches, alternate."""
    rules, kinds = [], []
    for i, r in enumerate(secret_scan.RULES):
        p = _quoted(r.pattern)
        test = f"length(regexp_extract_all(t, {p}, {r.group})[i]) >= {r.least}"
        rules.append(f"regexp_extract_all(t, {p}) AS h{i}, string_split_regex(t, {p}) AS s{i}")
        kinds.append(
            f"list_transform(list_filter(range(1, len(h{i}) + 1), lambda i: {test}), lambda i: {{'s': (list_sum(list_transform(s{i}[1:i], lambda x: length(x))) "
            f"+ coalesce(list_sum(list_transform(h{i}[1:i - 1], lambda x: length(x))), 0))::BIGINT, 'o': {i}, 'e': (list_sum(list_transform(s{i}[1:i], lambda x: length(x))) "
            f"+ list_sum(list_transform(h{i}[1:i], lambda x: length(x))))::BIGINT, 'k': '{r.kind}'}})"
        )
    everything = kinds[0]
    for k in kinds[1:]:
        everything = f"list_concat({everything}, {k})"
    joined = "array_to_string(list_transform({}, lambda x: concat(x.k, ':', x.s, ':', x.e)), ',')"
    base = f"list_filter(f, lambda x: x.o < {len(secret_scan.BASE)})"
    counts = ", ".join(f"len(list_filter(f, lambda x: x.k = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in secret_scan.BASE)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, t, {', '.join(rules)} FROM d), "
        f"f AS (SELECT doc_id, list_sort({everything}) AS f FROM m) "
        f"SELECT doc_id, {counts}, sha256({joined.format(base)}) AS base_sha256, {joined.format('f')} AS spans FROM f"
    )


def contamination_sql() -> str:
    """Every window of every item against every window of the documents."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    n = f"least({winnow.SPAN}, len(w))"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), i AS (SELECT item_id, {words} AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item_id, w, {n} AS n, unnest(range(1, len(w) - {n} + 2)) AS s FROM i WHERE len(w) > 0)),
dg AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, s, item_id FROM dg JOIN ig USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def fingerprints_sql() -> str:
    """The same trees from lists, leaves first; a text, its edited text and the next one are three rows.

    Differing places come from rows: one for each section that both trees do not
    have in common, then one for each paragraph of those.
    """
    f, node = fingerprint, fingerprint.NODE_DIGITS
    same = "list_transform(list_zip({a}, {b}), lambda z: z[1] IS NOT DISTINCT FROM z[2])"
    first = lambda a, b: f"list_position({same.format(a=a, b=b)}, false) - 1"
    last = lambda a, b: f"least({first(f'list_reverse({a})', f'list_reverse({b})')}, len({a}) - p, len({b}) - p)"
    rows = "SELECT {keep}, p + i - 1 AS nth, a[p + i] AS x, b[p + i] AS y, i > len(a) - p - r AS only_b, i > len(b) - p - r AS only_a FROM (SELECT *, unnest(range(1, greatest(len(a), len(b)) - p - r + 1)) AS i FROM {of})"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
e AS (SELECT doc_id, t, nt, length(t) AS n, concat(substring(t, 1, length(t) - length(t) // 3), substring(nt, 1, length(t) // 3)) AS et FROM o),
u AS (SELECT doc_id, 1 AS part, t AS x FROM e UNION ALL SELECT doc_id, 2, et FROM e UNION ALL SELECT doc_id, 3, nt FROM e),
l AS (SELECT doc_id, part, x, list_transform(string_split(x, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{f.LEAF}'), lambda y: md5(y)))) AS l FROM u),
p AS (SELECT doc_id, part, x, list_distinct(list_transform(flatten(flatten(l)), lambda y: substring(y, 1, {f.LEAF_DIGITS}))) AS leaves,
list_transform(l, lambda s: list_transform(s, lambda p: concat(substring(md5(array_to_string(p, '')), 1, {node}), ':', array_to_string(list_transform(p, lambda y: substring(y, 1, {f.LEAF_DIGITS})), '.')))) AS p FROM l),
s AS (SELECT doc_id, part, x, leaves, list_transform(p, lambda s: concat(substring(md5(array_to_string(list_transform(s, lambda q: substring(q, 1, {node})), ',')), 1, {node}), '=', array_to_string(s, ','))) AS s FROM p),
f AS (SELECT doc_id, part, leaves, s, substring(sha256(concat(length(x), ':', array_to_string(list_transform(s, lambda y: substring(y, 1, {node})), ','))), 1, {f.ROOT_DIGITS}) AS root FROM s),
g AS (SELECT a.doc_id, a.s AS a, b.s AS b FROM f a JOIN f b USING (doc_id) WHERE a.part = 1 AND b.part = 2 AND a.root <> b.root),
g1 AS (SELECT *, {last("a", "b")} AS r FROM (SELECT *, {first("a", "b")} AS p FROM g)),
h AS ({rows.format(keep="doc_id", of="g1")}),
k AS (SELECT doc_id, nth AS section, string_split(substring(x, {node + 2}), ',') AS a, string_split(substring(y, {node + 2}), ',') AS b FROM h WHERE NOT only_a AND NOT only_b AND x <> y),
k1 AS (SELECT *, {last("a", "b")} AS r FROM (SELECT *, {first("a", "b")} AS p FROM k)),
m AS ({rows.format(keep="doc_id, section", of="k1")}),
w AS (SELECT doc_id, nth AS section, -1 AS paragraph, nth::VARCHAR AS place FROM h WHERE only_a OR only_b
UNION ALL SELECT doc_id, section, nth, concat(section, ':', nth) FROM m WHERE only_a OR only_b OR x <> y),
v AS (SELECT doc_id, count(*)::INTEGER AS n, string_agg(place, ',' ORDER BY section, paragraph) AS places FROM w GROUP BY doc_id)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.et) AS edited_sha256, concat(a.root, ';', array_to_string(a.s, ';')) AS fingerprint, concat(b.root, ';', array_to_string(b.s, ';')) AS edited_fingerprint,
CASE WHEN a.root = b.root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, b.leaves)) / greatest(len(a.leaves) + len(b.leaves), 1) END AS near_edited,
CASE WHEN a.root = c.root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, c.leaves)) / greatest(len(a.leaves) + len(c.leaves), 1) END AS near_next,
coalesce(v.n, 0)::INTEGER AS n_differing, coalesce(v.places, '') AS differing
FROM e JOIN f a ON a.doc_id = e.doc_id AND a.part = 1 JOIN f b ON b.doc_id = e.doc_id AND b.part = 2 JOIN f c ON c.doc_id = e.doc_id AND c.part = 3 LEFT JOIN v ON v.doc_id = e.doc_id"""


def shards_sql() -> str:
    """Every prefix of every address; a row's shard is the shortest one whose bucket fits."""
    return f"""WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(concat(doc_id, ':', coalesce(text, ''))) AS c FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c) - 1 AS i FROM d),
a AS (SELECT doc_id, n_bytes, i, concat(substring(c, 1, 8), substring(md5(concat(c, ':', i)), 1, 8)) AS h FROM o),
b AS (SELECT doc_id, n_bytes, i, array_to_string(list_transform(range(1, 17), lambda x: lpad(bin(strpos('0123456789abcdef', substring(h, x, 1)) - 1), 4, '0')), '') AS bits FROM a),
p AS (SELECT *, unnest(range(0, 65)) AS depth FROM b),
s AS (SELECT substring(bits, 1, depth) AS shard, depth, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL),
f AS (SELECT p.doc_id, p.i, p.n_bytes, s.*, row_number() OVER (PARTITION BY p.bits, p.doc_id, p.i ORDER BY s.depth) AS n
FROM p JOIN s ON s.depth = p.depth AND s.shard = substring(p.bits, 1, p.depth) WHERE shard_bytes <= {sharding.SHARD_BYTES} OR shard_rows = 1 OR s.depth = 64)
SELECT doc_id, n_bytes, shard, depth::INTEGER AS depth, shard_bytes, shard_rows, shard_bytes <= {sharding.SHARD_BYTES} AS fits FROM f WHERE n = 1"""


def urls_sql() -> str:
    """Rules as one CASE, longest first; the model's weights as one list."""
    u = url_filter
    bias, weights = u.fit(tuple(u.labelled_urls()))
    rules = sorted(u.RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{of(r)}'" for r in rules) + " END"
    grams = []
    for mark, text in (("h", "host"), ("p", "translate(path, '123456789', '000000000')")):
        for n in u.SIZES:
            cut = f"list_transform(range(1, length({text}) + 4 - {n}), lambda i: md5(concat('{mark}', substring(concat('^', {text}, '$'), i, {n}))))"
            grams.append(f"list_transform({cut}, lambda x: ('0x' || substring(x, 1, 4))::INT % {u.BUCKETS})")
    found = grams[0]
    for g in grams[1:]:
        found = f"list_concat({found}, {g})"
    return f"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{u.HOST}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{u.PATH}', 1) AS path FROM pages),
f AS (SELECT *, list_distinct({found}) AS f FROM p),
g AS (SELECT *, list_sum(list_transform(f, lambda i: w[i + 1]))::DOUBLE AS total FROM f, (SELECT {list(weights)}::BIGINT[] AS w)),
s AS (SELECT *, floor(coalesce(total, 0) / greatest(len(f), 1))::BIGINT + {bias} AS logit FROM g)
SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, coalesce({case(lambda r: r[0])}, CASE WHEN logit >= {u.BLOCK_AT} THEN 'block' ELSE 'allow' END) AS verdict, logit::BIGINT AS logit FROM s"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII string, bit by bit."""
    bytes_ = f"list_transform(range(0, 8 * length({text})), lambda j: CASE WHEN j % 8 = 0 THEN ascii(substring({text}, (j // 8 + 1)::INT, 1))::BIGINT ELSE 0::BIGINT END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def manifest_sql() -> str:
    """Trees level by level; then every leaf climbs them, with its proof and with its folded root."""
    leaf = lambda text: "sha256(concat(" + ", ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(strlen({v}::VARCHAR), ':', {v}) END" for v in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    climb = "SELECT g, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {} WHERE n > 1 GROUP BY g, l, i // 3, n"
    runs = "SELECT g, l, i // 3 AS j, list(h ORDER BY i) AS h FROM {} GROUP BY ALL"
    left, right = "array_to_string(x.h[1:u.i % 3], '')", "array_to_string(x.h[u.i % 3 + 2:], '')"
    step = f"SELECT u.r, u.g, u.l + 1, u.i // 3, (u.n + 2) // 3, concat(u.p, {left}, {right}), sha256(concat({left}, u.f, {right})) FROM {{}} u JOIN {{}} x ON x.g IS NOT DISTINCT FROM u.g AND x.l = u.l AND x.j = u.i // 3 WHERE u.n > 1"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, {leaf("text")} AS h, CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS o FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t(g, l, i, n, h) AS (SELECT source, 0, i, n, h FROM b UNION ALL {climb.format("t")}),
s AS (SELECT g AS source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
e(g, l, i, n, h) AS (SELECT 0, 0, i, n, h FROM s UNION ALL {climb.format("e")}),
tx AS ({runs.format("t")}), ex AS ({runs.format("e")}),
u(r, g, l, i, n, p, f) AS (SELECT r, source, 0, i, n, '', coalesce(o, h) FROM b UNION ALL {step.format("u", "tx")}),
v(r, g, l, i, n, p, f) AS (SELECT u.r, 0, 0, s.i, s.n, u.p, u.f FROM u JOIN s ON s.source IS NOT DISTINCT FROM u.g WHERE u.n = 1 UNION ALL {step.format("v", "ex")})
SELECT b.doc_id, b.h AS leaf, s.h AS subroot, top.h AS root, sha256(v.p) AS proof_sha256, v.f AS folded_root, v.f = top.h AS verified
FROM b JOIN s ON s.source IS NOT DISTINCT FROM b.source JOIN v ON v.r = b.r AND v.n = 1 CROSS JOIN (SELECT h FROM e WHERE n = 1) top"""


def trie_sql() -> str:
    """Every prefix of every rebuilt conversation; nodes are groups of equal prefixes, subtrees are their longer prefixes."""
    return rf"""WITH t AS (SELECT conv_id, turn, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS v FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(v ORDER BY turn NULLS FIRST, md5(concat(strlen(v.r), ':', v.r, v.x))) AS a FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, c.a, h.a AS ha, ({crc32_sql("c.conv_id::VARCHAR")} % 4)::INT AS n FROM c LEFT JOIN c h ON h.conv_id = c.conv_id - c.conv_id % 20),
f AS (SELECT conv_id, list_concat(coalesce(ha[1:n], []), a[n + 1:]) AS a FROM b),
p AS (SELECT conv_id, d, len(a) = d AS ends, a[1:d] AS p, CASE WHEN d > 0 THEN len(regexp_extract_all(a[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM (SELECT conv_id, a, unnest(range(0, len(a) + 1)) AS d FROM f)),
n AS (SELECT p, d, min(conv_id) AS id, count(*) AS k, any_value(w) AS w, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM p GROUP BY p, d),
k AS (SELECT n.*, coalesce(m.c, 0) AS c FROM n LEFT JOIN (SELECT p[1:d - 1] AS p, count(*) AS c FROM n WHERE d > 0 GROUP BY ALL) m ON m.p = n.p),
s AS (SELECT p[1:u] AS p, sum((c = 0)::BIGINT)::BIGINT AS leaves, sum((k - 1) * w)::BIGINT AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM k) GROUP BY 1)
SELECT k.id AS conv_id, k.d::BIGINT AS depth, up.id AS parent_conv_id, k.k AS n_convs, k.c::BIGINT AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN s ON s.p = k.p LEFT JOIN n up ON up.d = k.d - 1 AND up.p = k.p[1:k.d - 1]"""


def oracle() -> dict[str, str]:
    return {
        "op1_merkle_fingerprints": fingerprints_sql(),
        "op3_secret_scan": secrets_sql(),
        "op4_extendible_sharding": shards_sql(),
        "op6_winnowing_decontamination": contamination_sql(),
        "op7_url_filter": urls_sql(),
        "op11_prefix_trie": trie_sql(),
        "op13_merkle_manifest": manifest_sql(),
    }
