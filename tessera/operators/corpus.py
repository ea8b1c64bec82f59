"""Documents: quality gates, copies, keys, links, graphs, paragraphs, chunks."""

from __future__ import annotations

from tessera.functions.text import defect, garbled
from tessera.plans.dialect import Dialect


def quality_gate(d: Dialect) -> str:
    return f"SELECT doc_id, {defect(d, 'text')} AS kusur FROM {d.t('documents')}"


def garbled_flag(d: Dialect) -> str:
    return f"SELECT doc_id, {garbled(d, 'text')} AS bozuk FROM {d.t('documents')}"


def quality_histogram(d: Dialect) -> str:
    return f"SELECT coalesce(kusur, 'saglam') AS kusur, count(*) AS n FROM ({quality_gate(d)}) GROUP BY 1"


def best_copy(d: Dialect) -> str:
    """Of equal texts the longest, then the last; the others are set aside."""
    return f"SELECT doc_id, h, rk = 1 AS kept FROM (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, source DESC, doc_id DESC) AS rk FROM {d.t('documents')})"


def collision_keys(d: Dialect) -> str:
    """Keys that recur get a distinguishing suffix; then the first row wins."""
    s = d.string
    return f"""WITH k AS (SELECT event_id, concat(cast(user_id AS {s}), '_', event_type) AS base, count(*) OVER (PARTITION BY user_id, event_type) AS n, cast(cast(ts AS date) AS {s}) AS day FROM {d.t('events')}),
x AS (SELECT event_id, CASE WHEN n > 1 THEN concat(base, '_', replace(day, '-', '')) ELSE base END AS anahtar FROM k)
SELECT event_id, anahtar FROM (SELECT *, row_number() OVER (PARTITION BY anahtar ORDER BY event_id) AS rk FROM x) WHERE rk = 1"""


def fallback_join(d: Dialect) -> str:
    """Exact key first; then the key without its suffix (here: url query)."""
    p = d.t("pages")
    cut = d.sub("url", r"[?#].*$", "")
    return f"""WITH named AS (SELECT {cut} AS k, min(page_id) AS first_id FROM {p} GROUP BY 1)
SELECT p.page_id, e.first_id AS exact_id, coalesce(e.first_id, f.first_id) AS resolved_id FROM {p} p LEFT JOIN named e ON e.k = p.url LEFT JOIN named f ON f.k = {d.sub('p.url', '[?#].*$', '')}"""


def entity_resolve_4tier(d: Dialect) -> str:
    """Of every row of orders, the part that it cites by number (a size), type
    hint and name word. One candidate is taken; a hint narrows them unless it
    leaves none; of several, the only one whose name is said, else the largest
    series, which alone is not reliable. A citation of itself goes at the end.

    Candidates are counted and their largest members found per number, type and
    name before the join, which is then by equality and makes one row a
    citation, however many candidates a number has.
    """
    part, orders = d.t("part"), d.t("orders")
    small = lambda keys: f"SELECT {keys}, count(*) AS n, max(c) AS c FROM cand GROUP BY {keys}"
    if not d.spark:  # as the cascade reads, candidate by candidate
        return f"""WITH asked AS (SELECT o_orderkey AS q, o_custkey AS own, cast(o_orderkey % 60 AS int) AS no, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE split_part(p_type, ' ', 1) END AS hint, split_part(p_name, ' ', 1) AS word FROM {orders} JOIN {part} ON p_partkey = o_custkey),
cand AS (SELECT a.*, p.p_partkey AS c, coalesce(split_part(p.p_type, ' ', 1) = a.hint, false) AS typed, split_part(p.p_name, ' ', 1) = a.word AS named FROM asked a JOIN {part} p ON p.p_size = a.no),
t AS (SELECT *, count(*) OVER (PARTITION BY q) AS n0, bool_or(typed) OVER (PARTITION BY q) AS any_typed FROM cand),
v AS (SELECT *, count(*) OVER (PARTITION BY q) AS n, sum(CASE WHEN named THEN 1 ELSE 0 END) OVER (PARTITION BY q) AS nn FROM t WHERE typed OR NOT any_typed),
w AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN nn = 1 AND named THEN 0 ELSE 1 END, c DESC) AS rk FROM v)
SELECT q, c AS hedef, CASE WHEN n = 1 AND hint IS NOT NULL THEN 'numara+tur' WHEN n = 1 THEN 'numara' WHEN nn = 1 THEN 'numara+ad' ELSE 'numara+tertip' END AS yontem, n = 1 OR nn = 1 AS guvenilir FROM w WHERE rk = 1 AND c <> own"""
    return f"""WITH asked AS (SELECT o_orderkey AS q, o_custkey AS own, cast(o_orderkey % 60 AS int) AS no, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE split_part(p_type, ' ', 1) END AS hint, split_part(p_name, ' ', 1) AS word FROM {orders} JOIN {part} ON p_partkey = o_custkey),
cand AS (SELECT p_size AS no, split_part(p_type, ' ', 1) AS typ, split_part(p_name, ' ', 1) AS word, p_partkey AS c FROM {part}),
r AS (SELECT a.*, t.n IS NOT NULL AS typed, n0.n AS n0, n0.c AS c0, t.n AS n1, t.c AS c1, w.n AS w0, w.c AS wc0, tw.n AS w1, tw.c AS wc1 FROM asked a
 JOIN ({small('no')}) n0 ON n0.no = a.no LEFT JOIN ({small('no, typ')}) t ON t.no = a.no AND t.typ = a.hint
 LEFT JOIN ({small('no, word')}) w ON w.no = a.no AND w.word = a.word LEFT JOIN ({small('no, typ, word')}) tw ON tw.no = a.no AND tw.typ = a.hint AND tw.word = a.word),
v AS (SELECT q, own, hint, CASE WHEN typed THEN n1 ELSE n0 END AS n, CASE WHEN typed THEN c1 ELSE c0 END AS c, coalesce(CASE WHEN typed THEN w1 ELSE w0 END, 0) AS nn, CASE WHEN typed THEN wc1 ELSE wc0 END AS wc FROM r),
x AS (SELECT q, own, CASE WHEN nn = 1 THEN wc ELSE c END AS hedef, CASE WHEN n = 1 AND hint IS NOT NULL THEN 'numara+tur' WHEN n = 1 THEN 'numara' WHEN nn = 1 THEN 'numara+ad' ELSE 'numara+tertip' END AS yontem, n = 1 OR nn = 1 AS guvenilir FROM v)
SELECT q, hedef, yontem, guvenilir FROM x WHERE hedef <> own"""


def _edges(d: Dialect) -> str:
    p = d.t("pages")
    links = d.all("html", 'href="([^"]*)"', 1)
    return f"""raw AS (SELECT page_id, link FROM (SELECT page_id, {links} AS links FROM {p}), {d.each('links', 't(link)')}),
hosts AS (SELECT page_id, {d.find('url', '://([^/?#]*)', 1)} AS kaynak FROM {p}),
edges AS (SELECT DISTINCT h.kaynak, CASE WHEN {d.find('r.link', '://([^/?#]*)', 1)} <> '' THEN {d.find('r.link', '://([^/?#]*)', 1)} ELSE r.link END AS hedef FROM raw r JOIN hosts h ON h.page_id = r.page_id)"""


def link_edges(d: Dialect) -> str:
    return f"WITH {_edges(d)} SELECT kaynak, hedef, 'dayanak' AS iliski FROM edges WHERE hedef <> '' AND kaynak <> hedef"


def in_degree_topk(d: Dialect) -> str:
    return f"WITH {_edges(d)} SELECT hedef, count(*) AS n FROM edges WHERE hedef <> '' AND kaynak <> hedef GROUP BY hedef ORDER BY n DESC, hedef LIMIT 25"


def one_hop(d: Dialect) -> str:
    """The sources of every target that several sources cite."""
    return f"WITH {_edges(d)} SELECT e.hedef, e.kaynak FROM edges e JOIN (SELECT hedef FROM edges GROUP BY hedef HAVING count(*) > 1) t ON t.hedef = e.hedef WHERE e.kaynak <> e.hedef"


def page_links(d: Dialect) -> str:
    """The last document link of each page (pdf or doc)."""
    found = d.all("html", r'href="([^"]*\.(?:pdf|doc))"', 1)
    last = "CASE WHEN size(l) > 0 THEN element_at(l, -1) END" if d.spark else "l[-1]"
    return f"SELECT page_id, {last} AS link FROM (SELECT page_id, {found} AS l FROM {d.t('pages')})"


def html_text(d: Dialect) -> str:
    """The longest block of a page as its text, tags removed."""
    clean = d.sub("x", "<[^>]*>", " ")
    return f"""SELECT page_id, metin FROM (SELECT page_id, metin, row_number() OVER (PARTITION BY page_id ORDER BY length(metin) DESC, metin) AS rk FROM (
 SELECT page_id, trim({d.sub(clean, '[ \\t\\r\\n]+', ' ')}) AS metin FROM (SELECT page_id, {d.split('html', '</?(?:p|div|h1|body|html)[^>]*>')} AS b FROM {d.t('pages')}), {d.each('b', 't(x)')})) WHERE rk = 1"""


def paragraph_split(d: Dialect) -> str:
    """Lines of 20 characters or more, numbered from 0."""
    if d.spark:
        return f"SELECT doc_id, cast(sira AS bigint) AS sira, trim(p) AS govde FROM (SELECT doc_id, filter(split(text, r'\\n'), x -> length(trim(x)) >= 20) AS ps FROM {d.t('documents')}), LATERAL posexplode(ps) AS t(sira, p)"
    return f"SELECT doc_id, cast(sira AS bigint) AS sira, trim(p) AS govde FROM (SELECT doc_id, unnest(range(len(ps))) AS sira, unnest(ps) AS p FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 20) AS ps FROM {d.t('documents')}))"


def source_block(d: Dialect) -> str:
    """Numbered sources of each language's first ten documents, joined."""
    s = d.string
    part = f"concat('[', cast(rk AS {s}), '] ', source, ': ', substr(text, 1, 200))"
    nl = "'\\n\\n'" if d.spark else "chr(10) || chr(10)"
    return f"SELECT lang, {d.join(d.listed(part, 'rk'), nl)} AS blok FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rk FROM {d.t('documents')}) WHERE rk <= 10 GROUP BY lang"


def citation_resolve(d: Dialect) -> str:
    """Bracketed numbers in a text against the ordinals 1 to 30: valid or made up.
    No text of the table cites, so each is told to, with decoys that do not count."""
    s = d.string
    said = f"concat(coalesce(text, ''), ' [', cast(doc_id % 45 AS {s}), '] (7) ', cast(doc_id AS {s}), ' [1234] [', cast(n_chars % 40 AS {s}), ']')"
    found = d.all(said, r"\[([0-9]{1,3})\]", 1)
    return f"SELECT doc_id, n, n BETWEEN 1 AND 30 AS gecerli FROM (SELECT DISTINCT doc_id, cast(c AS int) AS n FROM (SELECT doc_id, {found} AS cs FROM {d.t('documents')}), {d.each('cs', 't(c)')})"


def bucket_status(d: Dialect) -> str:
    """Catalogue, labels and pages classify a document in priority order."""
    return f"""SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'bozuk' WHEN l.toxic = 1 THEN 'tasinacak' WHEN l.doc_id IS NULL AND p.page_id IS NULL THEN 'eksik' WHEN p.page_id IS NULL THEN 'metni_yok' ELSE 'saglam' END AS kova
FROM {d.t('documents')} d LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM {d.t('labels')} GROUP BY doc_id) l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT page_id FROM {d.t('pages')}) p ON p.page_id = d.doc_id"""


def venn_labels(d: Dialect) -> str:
    """Two sources side by side: in both, or in one only."""
    return f"SELECT durum, count(*) AS n FROM (SELECT CASE WHEN a.id IS NULL THEN 'b_only' WHEN b.id IS NULL THEN 'a_only' ELSE 'both' END AS durum FROM (SELECT DISTINCT doc_id AS id FROM {d.t('documents')}) a FULL OUTER JOIN (SELECT DISTINCT vec_id AS id FROM {d.t('embeddings')}) b ON a.id = b.id) GROUP BY durum"


def name_prefix_match(d: Dialect) -> str:
    """Every page and the first other source of its key whose folded name starts
    as its own does, one way or the other; where a key has one page and one
    source, that source. Pages stand for texts, events' types of a key for PDFs.

    The first 20 characters decide, of the shorter name all it has: names of 20
    or more meet by equality of their heads, the shorter ones (of which there
    are few) by each length that occurs.
    """
    key, name = d.find("url", "://(?:www.|m.|blog.)?([^/?#.]*)", 1), f"lower({d.sub('url', '^[a-z]+://[^/]*|[^A-Za-z]', '')})"
    base = f"""t AS (SELECT page_id, {key} AS no, substr({name}, 1, 20) AS ad FROM {d.t('pages')}),
p AS (SELECT cast(page_id AS bigint) AS pdf, no, substr(ad, 1, cast(20 - page_id % 12 AS int)) AS ad FROM t WHERE page_id % 3 <> 0),
many AS (SELECT t.no, count(*) AS nt, max(q.np) AS np, max(q.pdf) AS pdf FROM t JOIN (SELECT no, count(*) AS np, min(pdf) AS pdf FROM p GROUP BY no) q ON q.no = t.no GROUP BY t.no)"""
    if d.spark:  # by equality of heads: of each length that a name may have
        cut = "SELECT page_id, no, k, substr(ad, 1, k) AS head, length(ad) AS n FROM t, LATERAL explode(sequence(1, length(ad))) AS l(k)"
        other = "SELECT no, k, substr(ad, 1, k) AS head, length(ad) AS n, min(pdf) AS pdf FROM p, LATERAL explode(sequence(1, length(ad))) AS l(k) GROUP BY ALL"
        hit = f"hit AS (SELECT a.page_id, min(b.pdf) AS pdf FROM ({cut}) a JOIN ({other}) b ON a.no = b.no AND a.k = b.k AND a.head = b.head AND a.k = least(a.n, b.n) GROUP BY a.page_id)"
    else:
        hit = "hit AS (SELECT t.page_id, min(p.pdf) AS pdf FROM t JOIN p ON t.no = p.no AND t.ad <> '' AND p.ad <> '' AND (starts_with(t.ad, p.ad) OR starts_with(p.ad, t.ad)) GROUP BY t.page_id)"
    return f"WITH {base}, {hit} SELECT t.page_id AS a, coalesce(h.pdf, m.pdf) AS b FROM t JOIN many m ON m.no = t.no LEFT JOIN hit h ON h.page_id = t.page_id WHERE h.pdf IS NOT NULL OR (m.nt = 1 AND m.np = 1)"


PLANS = (quality_gate, garbled_flag, quality_histogram, best_copy, collision_keys, fallback_join, entity_resolve_4tier, link_edges, in_degree_topk, one_hop, page_links, html_text, paragraph_split, source_block, citation_resolve, bucket_status, venn_labels, name_prefix_match)
