"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from . import licenses, secrets
from .common import UPPER


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def op5() -> str:
    """Every place of a first key phrase, the other key phrases within the slack of theirs, and the share of the template's different words around it."""
    parts = []
    for t in (*licenses.BASE, *licenses.MORE):
        (at, key), *others = t.phrases
        starts = f"list_transform(list_filter(range(0, len(w)), lambda k: w[k + 1:k + {len(key)}] = {_list(key)}), lambda k: k - {at})"
        rest = "".join(f" AND len(list_filter(range(greatest(s + {a - t.slack}, 0), s + {a + t.slack + 1}), lambda k: w[k + 1:k + {len(k_)}] = {_list(k_)})) > 0" for a, k_ in others)
        own = sorted(set(t.words))
        share = f"len(list_intersect({_list(own)}, w[greatest(s - {t.slack}, 0) + 1:s + {len(t.words) + t.slack}])) / {len(own)}::DOUBLE"
        places = f"list_transform(list_filter({starts}, lambda s: true{rest}), lambda s: {{'label': {_text(t.label)}, 'base': {str(t.base).lower()}, 'start': s, 'share': {share}}})"
        parts.append(f"CASE WHEN NOT contains(flat, {_text(' ' + ' '.join(key) + ' ')}) THEN [] ELSE list_filter({places}, lambda x: x.share >= {t.share}) END")
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), f AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS flat FROM d), p AS (SELECT doc_id, len(w) AS n_words, flatten([{", ".join(parts)}]) AS p FROM f),
      b AS (SELECT *, list_filter(p, lambda x: x.base) AS base FROM p)
      SELECT doc_id, n_words, len(base) AS n_base, list_min(list_transform(base, lambda x: x.start)) AS first_word, list_max(list_transform(base, lambda x: x.start)) AS last_word,
      coalesce(array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ','), '') AS labels,
      coalesce(list_max(list_transform(p, lambda x: x.share)), 0.0) AS score FROM b"""


def op6() -> str:
    """Every rule on every text; where a match begins is told by the lengths of what stands before it."""
    rules = (*secrets.BASE, *secrets.MORE)
    found, spans = [], []
    for n, r in enumerate(rules):
        p = _text(r.java)
        found.append(f"regexp_extract_all(t, {p}, 0) AS m{n}, regexp_extract_all(t, {p}, {r.group}) AS g{n}, regexp_split_to_array(t, {p}) AS p{n}")
        size = lambda c, to: f"coalesce(list_sum(list_transform({c}[1:{to}], lambda x: length(x))), 0)"
        start = f"{size(f'p{n}', 'i')} + {size(f'm{n}', 'i - 1')}"
        spans.append(f"list_transform(list_filter(range(1, len(m{n}) + 1), lambda i: length(g{n}[i]) >= {r.least}), lambda i: {{'s': ({start})::BIGINT, 'n': {n}, 'e': ({start})::BIGINT + length(m{n}[i])}})")
    kinds = _list([r.kind for r in rules])
    said = lambda c: f"coalesce(array_to_string(list_transform({c}, lambda x: {kinds}[x.n + 1] || ':' || x.s || ':' || x.e), ','), '')"
    counts = ", ".join(f"len(list_filter(a, lambda x: x.n = {n})) AS n_{r.kind}" for n, r in enumerate(secrets.BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {", ".join(found)} FROM d), s AS (SELECT doc_id, list_sort(flatten([{", ".join(spans)}])) AS a FROM f)
      SELECT doc_id, {counts}, sha256({said(f"list_filter(a, lambda x: x.n < {len(secrets.BASE)})")}) AS base_sha256, {said("a")} AS spans FROM s"""


OP9 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS keeper FROM p WHERE strlen(h) >= 1000 GROUP BY h)
      SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM p LEFT JOIN g ON p.h = g.h"""

#: CRC-32 of each distinct feature, from a table of the polynomial's 256 remainders; the runs of a text's words by places.
OP11 = f"""WITH RECURSIVE rem AS (SELECT range AS x, range AS c, 0 AS k FROM range(256) UNION ALL SELECT x, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM rem WHERE k < 8),
      tab AS (SELECT list(c ORDER BY x) AS t FROM rem WHERE k = 8),
      a AS (SELECT doc_id, false AS target, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents UNION ALL SELECT item_id, true, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
      f AS (SELECT doc_id, target, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i]) || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM a),
      d AS (SELECT DISTINCT f FROM f),
      h AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b FROM d, tab),
      p AS (SELECT doc_id, target, b FROM f JOIN h USING (f)),
      n AS (SELECT b, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM p GROUP BY b),
      g AS (SELECT b, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS g FROM n),
      m AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM p JOIN g USING (b) WHERE NOT target GROUP BY doc_id),
      o AS (SELECT a.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, floor(-1000 * ln(-ln((('0x' || sha256('42:' || a.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM a LEFT JOIN m ON a.doc_id = m.doc_id WHERE NOT target),
      r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER (PARTITION BY words >= 20) AS n FROM o)
      SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM r"""

#: All n-grams of all pieces, every cut of the candidates, products of 128 bits.
OP12 = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(unnest(string_split_regex({LOW}, '[.,;:!?\\x0A-\\x0D]')), '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM documents),
      f AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase FROM p WHERE len(w) > 0) GROUP BY ALL),
      n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
      c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE f >= 100 AND contains(phrase, ' ')),
      d AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS m WHERE m.lang = c.lang AND len(m.w) > len(c.w) AND contains(' ' || m.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * m.a >= 100 * c.a)),
      k AS (SELECT lang, phrase, w, a, unnest(range(1, len(w))) AS k FROM d),
      s AS (SELECT k.*, h.f AS l, t.f AS r, n.n, ((1000::HUGEINT * a * n.n) // (h.f::HUGEINT * t.f))::BIGINT AS score FROM k JOIN f h ON h.lang = k.lang AND h.phrase = array_to_string(w[1:k], ' ') JOIN f t ON t.lang = k.lang AND t.phrase = array_to_string(w[k + 1:], ' ') JOIN n ON n.lang = k.lang),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000"""

SQL = {"op5_license_scan": op5(), "op6_secret_scan": op6(), "op9_warc": OP9, "op11_importance_resampling": OP11, "op12_phrase_collocations": OP12}
