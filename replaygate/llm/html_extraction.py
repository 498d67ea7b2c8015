"""Main text of HTML pages from flat text blocks (operator 12).

A page is cut into flat blocks of text at its block-level tags. Each block has its
word count, its link density and those of the blocks before and after it, with a
few marks of where it stands (inside an article, inside a menu, a form, ...). A
decision tree, trained on a small labelled table of blocks, says which blocks are
main text; those are joined in page order by one space.

Training runs on the driver on `labelled_blocks()`, which is of fixed size. Pages
are read in Arrow batches, one page at a time, and nothing is shuffled: page texts
stay in their tasks, and repeated pages are extracted each on its own.

A null, empty or text-free page gives an empty text. White space is what
`str.split` takes as such. Very long pages are handled whole.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path

# Element names of the HTML standard.
#: Elements whose content is not text of the page.
SILENT = "script style noscript template svg math head iframe object canvas audio video select option datalist textarea button title".split()
#: Elements inside a line; every other tag ends a block.
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
#: Elements without an end tag.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Elements that end an open one of their kind.
ONE_AT_A_TIME = "p li a td th tr dt dd".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()

# Words in tag names, classes, ids and roles that tell what a part of a page is for.
GOOD = "article main content post entry hentry story body text articlebody maincontent".split()
BAD = ("nav navigation navbar menu submenu breadcrumb breadcrumbs header masthead topbar banner footer foot bottom copyright legal aside sidebar "
       "rail widget related recommended recommendations popular trending more notice cookie cookies consent gdpr alert popup modal overlay "
       "ad ads adv advert advertisement adsense promo promotion sponsor sponsored form search login signup newsletter subscribe "
       "comment comments reply replies disqus respond discussion feedback share sharing social pagination pager tags toolbar skip meta byline "
       "contentinfo complementary dialog").split()
#: Of BAD, what only opens an article when it stands inside one.
OPENING = "header masthead top".split()
_GOOD, _BAD, _SILENT, _INLINE, _VOID = frozenset(GOOD), frozenset(BAD), frozenset(SILENT), frozenset(INLINE), frozenset(VOID)
_ONE_AT_A_TIME, _HEADINGS = frozenset(ONE_AT_A_TIME), frozenset(HEADINGS)
_BAD_INSIDE = _BAD - frozenset(OPENING)

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_MARK = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_RAW = re.compile(r"script|style|textarea|title|iframe|noscript", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after",
            "in_good", "bad_inside", "bad_anywhere", "outside_article", "heading", "list_item")


def _purpose(name: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """(good, bad): what the name, class, id and role of an element say of it;
    `inside` a good part or not."""
    marks = {name}
    if attrs and name not in ("body", "html"):
        for m in _MARK.finditer(attrs):
            marks.update(w.lower() for w in _PARTS.findall(m[2] or m[3] or m[4] or ""))
    bad = not marks.isdisjoint(_BAD_INSIDE if inside else _BAD)
    return not bad and name not in ("body", "text") and not marks.isdisjoint(_GOOD), bad


def blocks(page: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """Flat blocks of a page in order: (text, link characters, inside a good part,
    bad parts inside the innermost good one, bad parts around it, heading, list item)."""
    out: list[tuple] = []
    # Open elements with what holds inside them: name, good, bad inside it, bad, heading, list item, silent, link.
    stack: list[tuple] = [("", 0, 0, 0, 0, 0, 0, 0)]
    opened: dict[str, int] = {}
    text, links = [], 0
    at, end, last = 0, len(page), page.rfind(">")

    def flush():
        nonlocal text, links
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, links, *stack[-1][1:6]))
        text, links = [], 0

    def add(piece: str):
        nonlocal links
        if piece and not stack[-1][6]:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if stack[-1][7]:
                links += len("".join(piece.split()))

    def close(upto: int):
        for e in stack[upto:]:
            opened[e[0]] -= 1
        del stack[upto:]

    while at < end:
        found = _TAG.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        attrs = found[3] or found[6] or ""
        if name not in _INLINE:
            flush()
        if found[1] or found[4]:
            if opened.get(name):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            continue
        if name in _VOID or attrs.endswith("/"):
            continue
        if _RAW.fullmatch(name):  # its content holds no tags
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in _ONE_AT_A_TIME and opened.get(name):  # it ends an open one of its kind
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] not in _INLINE and stack[i][0] != "p":
                    break
        _, in_good, bad_inside, bad_anywhere, heading, item, silent, link = stack[-1]
        good, bad = _purpose(name, attrs, bool(in_good))
        stack.append((name, 1 if good else in_good, 0 if good else bad_inside + bad, bad_anywhere + bad, int(heading or name in _HEADINGS), int(item or name == "li"),
                      silent or name in _SILENT or bool(attrs and _HIDDEN.search(attrs)), link or name == "a"))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """One row of FEATURES for each block of a page."""
    x = np.zeros((len(found), len(FEATURES)))
    if not found:
        return x
    words = np.array([b[0].count(" ") + 1 for b in found], dtype=float)
    chars = np.array([max(1, len(b[0]) - b[0].count(" ")) for b in found], dtype=float)
    density = np.minimum(1.0, np.array([b[1] for b in found]) / chars)
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
    rest = np.array([b[2:] for b in found], dtype=float)
    x[:, 6], x[:, 7], x[:, 8] = rest[:, 0], rest[:, 1], rest[:, 2]
    x[:, 9] = (rest[:, 0].max() > 0) & (rest[:, 0] == 0)
    x[:, 10], x[:, 11] = rest[:, 3], rest[:, 4]
    return x


# --- the labelled table -------------------------------------------------------------------

# Page plans. {+n} is a block of n words of main text, {-n} one of n words of anything else;
# each plan is filled with several lengths.
PLANS = (
    "<nav><ul><li><a>{-1}</a><li><a>{-1}</a><li><a>{-1}</a></ul></nav><div class=ad>{-8}</div><article><h1>{+9}</h1><p>{+3}<p>{+40}<p>{+9}</article><footer>{-9}</footer>",
    "<header><a>{-2}</a><h1>{-3}</h1></header><main><h1>{+7}</h1><p>{+50}</p><ul><li>{+6}</li><li>{+8}</li></ul><p>{+12}</p></main><aside><h3>{-3}</h3><p>{-25}</p></aside><footer><p>{-20}</p></footer>",
    "<div id=top><a>{-1}</a> <a>{-1}</a></div><div class=post><h2>{+6}</h2><p>{+60}</p><p>{+4}</p><p>{+35}</p></div><div id=comments><h3>{-2}</h3><p>{-30}</p><p>{-45}</p></div>",
    "<div class=cookie-notice><p>{-25}</p><a>{-1}</a></div><div class=content><h1>{+8}</h1><p>{+30}</p><blockquote>{+20}</blockquote><p>{+45}</p></div><div class=sidebar><p>{-30}</p><ul><li><a>{-4}</a><li><a>{-5}</a></ul></div>",
    "<div><a>{-1}</a> | <a>{-1}</a> | <a>{-2}</a></div><h1>{+8}</h1><p>{+45}</p><p>{+30}</p><p>{+8}</p><p>{+50}</p><div><a>{-2}</a> <a>{-2}</a></div><div>{-5}</div>",
    "<table><tr><td><a>{-2}</a></td><td><a>{-2}</a></td></tr></table><div><h1>{+7}</h1>{+70}<br><br>{+60}<br>{+40}</div><div><a>{-6}</a></div><div><a>{-7}</a></div><p>{-4}</p>",
    "<article><header><h1>{+9}</h1></header><p>{+40}</p><div class=ad>{-12}</div><p>{+35}</p><section class=comments><p>{-30}</p></section><p class=share><a>{-1}</a></p></article>",
    "<main><article><p>{+25}</p><form>{-6}<p>{-9}</p></form><p>{+22}</p><aside>{-30}</aside><p>{+2}</p></article><section id=comments><article class=comment><p>{-33}</p></article></section></main>",
    "<body class=has-sidebar><div class=banner>{-10}</div><main><h1>{+5}</h1><p>{+1}</p><p>{+33}</p><p>{+5}</p></main><div role=complementary><p>{-40}</p></div><div role=contentinfo>{-15}</div>",
    "<ul class=menu><li>{-1}</li><li>{-2}</li></ul><div class=entry-content><p>{+38}</p><ul><li><a>{+6}</a> {+20}</li><li>{+18}</li></ul><p>{+15}</p></div><div class=related><h4>{-3}</h4><a>{-8}</a></div><div class=newsletter><p>{-18}</p></div>",
    "<div class=alert>{-30}</div><article><h1>{+4}</h1><h2>{+12}</h2><p>{+90}</p><p>{+2}</p><nav><a>{-3}</a></nav><footer><p>{-14}</p></footer></article><aside class=promo><p>{-50}</p></aside>",
    "<nav>{-12}</nav><p>{+40}</p><p>{+44}</p><p>{+6}</p><p>{+36}</p><footer>{-22}</footer>",
    "<div class=header>{-6}</div><div id=main><p>{+18}</p><p>{+3}</p><table><tr><td>{+4}</td><td>{+3}</td></tr></table><p>{+28}</p></div><div class=footer><p>{-35}</p></div>",
    "<article><p><a>{+5}</a></p><p>{+26}</p><p><a>{+3}</a></p><p>{+14}</p></article><div><p>{-40}</p></div><div>{-8}</div><p>{-25}</p>",
    "<nav><a>{-2}</a></nav><div class=ad>{-20}</div><footer>{-30}</footer>",
    "<div class=login><p>{-7}</p></div><section class=story-body><h1>{+10}</h1><p>{+1}</p><p>{+2}</p><p>{+65}</p></section><section class=widget><p>{-45}</p></section><div class=copyright>{-6}</div>",
    "<article><h1>{+6}</h1><p>{+2}</p></article><footer>{-18}</footer>",
    "<main><p>{+5}</p><p>{+1}</p></main><div>{-3}</div><div><p>{-60}</p></div>",
    "<header>{-15}</header><h1>{+6}</h1><p>{+40}</p><h2>{+3}</h2><p>{+37}</p><p>{+42}</p><form><label>{-2}</label><p>{-12}</p></form><ol class=comments><li><p>{-30}</p><li><p>{-12}</p></ol>",
    "<h1>{+5}</h1><p>{+25}</p><p>{+6}</p>",
    "<p>{+30}</p>",
    "<p>{+12}</p><p>{+9}</p><p>{+16}</p>",
    "<div class=wrap><div class=site-header><a>{-3}</a></div><div class=entry-header><h1>{-4}</h1></div><div class=entry><div class=entry-header><h1>{+4}</h1></div><p>{+28}</p></div></div>",
    "<div>{-2}</div><div>{-1}</div><h1>{+7}</h1><p>{+48}</p><p>{+33}</p><p>{+55}</p><div>{-4}</div><div><a>{-3}</a></div>",
)
# Parts of pages that mark their article; every combination is a plan.
TOPS = ("", "<nav><a>{-1}</a><a>{-2}</a></nav>", "<header><a>{-2}</a></header><div class=ad>{-9}</div>", "<div class=notice>{-25}</div>", "<div>{-4}</div>")
MIDDLES = ("<h1>{+5}</h1><p>{+1}</p><p>{+40}</p>", "<p>{+2}</p><p>{+1}</p>", "<header><h1>{+3}</h1></header><p>{+25}</p><ul><li>{+4}</li></ul><p><a>{+3}</a></p>",
           "<h1>{+9}</h1><p>{+30}</p><div class=ad>{-8}</div><p>{+3}</p>", "<p>{+60}</p><aside>{-20}</aside><p>{+5}</p><form>{-4}</form>")
TAILS = ("", "<footer>{-12}</footer>", "<div class=comments><p>{-30}</p><p>{-3}</p></div>", "<aside><ul><li><a>{-3}</a></ul></aside><div>{-6}</div>", "<div><p>{-45}</p></div>")
FILLINGS = 6
_SLOT = re.compile(r"\{([+-])(\d+)\}")


def all_plans() -> list[str]:
    wraps = ("<article>%s</article>", "<div id=content>%s</div>")
    return [*PLANS, *(top + wraps[(i + j) % 2] % middle + tail for i, top in enumerate(TOPS) for j, middle in enumerate(MIDDLES) for tail in TAILS)]


def labelled_pages(plans, fillings: int = FILLINGS):
    """The plans with words in their slots: the first word of a slot is its label."""
    for number, plan in enumerate(plans):
        for turn in range(fillings):
            slots = iter(range(1000))

            def fill(m):
                draw = zlib.crc32(f"{number}.{turn}.{next(slots)}".encode())
                n = int(m[2]) if turn == 0 else max(1, int(m[2]) * (50 + draw % 101) // 100)
                return " ".join([m[1]] + ["word"] * n)

            yield _SLOT.sub(fill, plan)


def labelled_blocks(plans=None, fillings: int = FILLINGS) -> tuple[np.ndarray, np.ndarray]:
    """(features, is main text) of all blocks of the labelled pages."""
    xs, ys = [], []
    for page in labelled_pages(plans or all_plans(), fillings):
        found = blocks(page)
        ys += [b[0].startswith("+") for b in found]
        # the label is no word of the text
        xs.append(features([(re.sub(r"(?:^|(?<= ))[+-] ", "", b[0]), *b[1:]) for b in found]))
    return np.vstack(xs), np.array(ys)


# --- the decision tree --------------------------------------------------------------------

def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 5):
    """A tree of Gini splits: leaves are shares of main text, inner nodes are
    (feature, threshold, tree where at most the threshold, tree where above)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = (2 * share * (1 - share) - 1e-12, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
        if not ok.any():
            continue
        left, right = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
        impurity = (n * 2 * left * (1 - left) + (len(y) - n) * 2 * right * (1 - right)) / len(y)
        i = int(np.argmin(np.where(ok, impurity, np.inf)))
        if impurity[i] < best[0]:
            best = (impurity[i], (f, float((v[i] + v[i + 1]) / 2)))
    if best[1] is None:
        return share
    f, threshold = best[1]
    low = x[:, f] <= threshold
    return f, threshold, train_tree(x[low], y[low], depth - 1, least), train_tree(x[~low], y[~low], depth - 1, least)


def classify(tree, x: np.ndarray) -> np.ndarray:
    """The share of main text that the tree gives each row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, threshold, low, high = tree
    below = x[:, f] <= threshold
    out = np.empty(len(x))
    out[below], out[~below] = classify(low, x[below]), classify(high, x[~below])
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    main = classify(tree, features(found)) > 0.5
    return " ".join(b[0] for b, is_main in zip(found, main) if is_main)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", tree=None) -> DataFrame:
    """`pages` without `html_col`, with `out_col`: the main text of each page."""
    tree = train_tree(*labelled_blocks()) if tree is None else tree
    rest = [c for c in pages.columns if c not in (html_col, out_col)]
    named = pages.select(F.col(f"`{html_col}`").cast("string").alias("__html"), *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)))
    schema = ", ".join([*(f"__{i} {named.schema[f'__{i}'].dataType.simpleString()}" for i in range(len(rest))), "__text string"])

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "__text"])

    return named.mapInArrow(run, schema).select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(rest)), F.col("__text").alias(out_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(table_path(sf_dir, "pages")).select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


#: Holds where, as in the given pages, the main text is what one <article> element marks.
ORACLE = r"""
WITH marked AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages
), plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS body FROM marked
), decoded AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS body FROM plain
)
SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS n_chars FROM decoded
"""
