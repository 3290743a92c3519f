"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element and each text block is a node that is content or not. Node potentials come from tags, names of classes and
ids, and the form of the text; parent-child potentials say how the state passes down. Sum-product messages go up the
tree and down again and give every block its exact marginal; blocks above one half are the text.

All potentials are trained from labelled pages: a bounded sample of pages whose markup names the main part (article or
main element, or such a role) labels its own nodes. In every second one the naming markup is hidden from the features,
so that the form of the text must carry the decision on pages without it; in every third one paragraphs count as plain
divisions, so that text straight inside div, section or td is a block like any paragraph. Weights of features that the
sample lacks stay at their prior values. Pages are chosen by a hash among those that name their main part and have at most
``PAGE_BYTES``, one per page_id: so the sample is as large where few pages do, and bounded in bytes.

Null or empty html has the text "". Pages of any length are read whole; unclosed or misnested tags are repaired as
browsers do for paragraphs, list items and table parts. Repeated rows are extracted alike; null urls and page_ids are
passed on; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 300
PAGE_BYTES = 1 << 18
NAMES_MAIN = r"(?i)<(article|main)[\s>/]|role=\"main\""
TEXTS = "page_id bigint, url string, text string, n_chars bigint"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>"
    r"|<[!?/][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")
CLOSED = re.compile(r"(?<!=)(?:^|[\s\"']|(?:^|\s)[^\s=\"']+)/\Z")  # not the end of a bare value
SPLIT_NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")

# Fixed sets of HTML names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
# Elements whose content is not shown as text; they do not break the text around them.
UNSEEN = frozenset("noscript template svg object audio video canvas select annotation annotation-xml".split())
# Elements in which '/>' closes, the tags of HTML that end them, and the parts of them that hold HTML.
FOREIGN = frozenset(("svg", "math"))
INTEGRATION = frozenset("foreignobject desc annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li listing main menu nav ol optgroup "
    "option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split())
BREAKOUT = BLOCK | frozenset("b big br code em embed hr i img meta nobr ruby s small span strong strike sub sup tt u var".split())
CHROME = frozenset("nav header footer aside form dialog menu button fieldset".split())
NAMED_MAIN = frozenset(("article", "main"))
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"),
}
CLOSE_LIMIT = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
# Whole parts of names: a word that only begins like one (page, format, football, commentary) says nothing.
HINT_AGAINST = frozenset(
    "nav navs navbar navigation topnav subnav sidenav menu menus menubar submenu breadcrumb breadcrumbs sidebar sidebars "
    "side widget widgets foot footer footers header headers masthead banner banners cookie cookies cookiebar "
    "cookiebanner cookienotice consent gdpr notice notices alert alerts popup popups modal modals overlay overlays ad ads "
    "adv advert adverts advertisement advertisements advertising adsense promo promos promotion promotions promoted "
    "sponsor sponsors sponsored share shares sharing sharebar sharedaddy sharethis social socials related recommend "
    "recommends recommended recommendation recommendations comment comments commentlist commentform commentbox "
    "commentarea postcomments disqus reply replies replied respond subscribe subscribes subscriber subscribers "
    "subscription subscriptions newsletter newsletters signup login search searchbar searchbox searchform form forms "
    "pager pagers pagination paginator paginate paging pagenav pagenavi copyright legal toolbar toolbars teaser teasers "
    "contentinfo complementary tags meta byline dialog".split())
HINT_FOR = frozenset(
    "article main content post entry story body text maintext bodytext articlebody maincontent".split())

# Element features: bias, names the main part, chrome tag, hint against, hint for, hidden, section or div.
ELEMENT_PRIOR = np.array([-1.0, 4.0, -6.0, -7.0, 2.0, -8.0, 0.0])
# Block features: bias, log words, link share, ends like a sentence, heading, list item, table cell, bare text.
BLOCK_PRIOR = np.array([-1.0, 0.6, -5.0, 1.0, 0.5, -0.5, -0.5, -0.5])
# Parent-child chances of content by the kind of edge, as pseudo-counts (parent's state, child's state). Chrome (by tag
# or hint) below content may well not be content; hardly anything below chrome is.
PAIR_PRIOR = {
    "plain": np.array([[20.0, 1.0], [0.5, 20.0]]),
    "chrome": np.array([[20.0, 0.1], [10.0, 10.0]]),
    "in_chrome": np.array([[200.0, 0.2], [1.0, 20.0]]),
    "block": np.array([[20.0, 0.5], [0.5, 20.0]]),
}
PAIR_COUNT = 200.0  # counts are scaled to this, as the pages of a sample are much alike
PRIOR_PRECISION = 2.0


def is_block(name: str) -> bool:
    """Named blocks and custom elements; all others, unknown names too, are inline."""
    return name in BLOCK or "-" in name


class Dom:
    """Elements and text blocks in document order; a parent's number is below its children's."""

    def __init__(self, page: str):
        self.parent = [-1]
        self.names: list[tuple] = [("#root", "")]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters inside links
        self._text: list[str] = []
        self._linked = 0
        self._runs: list[tuple[list[str], int]] = []  # text begun around each open element that is not shown
        self._foreign = 0
        stack: list[tuple[str, int]] = [("body", 0)]  # inline elements share their block's node
        self._stack, links, at, size = stack, 0, 0, len(page)
        while at < size:
            found = TOKEN.search(page, at)
            if found is None:
                self._add(page[at:], links)
                break
            if found.start() > at:
                self._add(page[at : found.start()], links)
            at = found.end()
            close, name, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if close:
                links -= self._close(name)
                continue
            if self._foreign and name in BREAKOUT:
                links -= self._break_out()
            if (self._foreign or name in FOREIGN) and CLOSED.search(rest):
                continue
            if name == "br" or name == "wbr":
                self._text.append("\n" if name == "br" else "")
                continue
            if name in VOID:
                if name == "hr":
                    self._flush()
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else size
                continue
            self._foreign += name in FOREIGN
            if name in UNSEEN:
                self._runs.append((self._text, self._linked))
                self._text, self._linked = [], 0
            elif not is_block(name):
                stack.append((name, stack[-1][1]))
                links += name == "a"
                continue
            else:
                self._flush()
                links -= self._implied(name)
            self.parent.append(stack[-1][1])
            self.names.append((name, rest))
            stack.append((name, len(self.parent) - 1))
        self._pop_to(1)
        self._flush()

    def _add(self, raw: str, links: int) -> None:
        self._text.append(raw)
        if links > 0:
            self._linked += len(raw)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.parent.append(self._stack[-1][1])
                self.names.append(("#text", ""))
                self.blocks.append((len(self.parent) - 1, text, self._linked))
            self._text, self._linked = [], 0

    def _pop_to(self, i: int) -> int:
        gone = 0
        while len(self._stack) > i:
            name = self._stack[-1][0]
            if name in UNSEEN or is_block(name):
                self._flush()
            if name in UNSEEN:
                self._text, self._linked = self._runs.pop()
            self._foreign -= name in FOREIGN
            gone += name == "a"
            self._stack.pop()
        return gone

    def _break_out(self) -> int:
        """Close the drawings and formulas that a tag of HTML ends."""
        gone = 0
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in INTEGRATION:
                break
            if self._stack[i][0] in FOREIGN:
                gone += self._pop_to(i)
        return gone

    def _implied(self, name: str) -> int:
        """Close what a new block element ends: an open paragraph, or parts of the same list or table."""
        gone, stack = 0, self._stack
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == "p":
                gone += self._pop_to(i)
                break
            if is_block(stack[i][0]):
                break
        same, limit = CLOSES.get(name, ()), CLOSE_LIMIT.get(name, ("table",))
        if same:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in limit:
                    break
                if stack[i][0] in same:
                    gone += self._pop_to(i)
                    if name in ("li", "dt", "dd"):
                        break
        return gone

    def _close(self, name: str) -> int:
        stack = self._stack
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                if is_block(name):
                    self._flush()
                return self._pop_to(i)
            if not is_block(name) and is_block(stack[i][0]):
                return 0  # a stray end tag does not leave its block
        return 0


def _hints(rest: str) -> tuple[bool, bool, bool]:
    """(against, for, hidden) from class, id and role; ``role`` values are names of the same kind."""
    against = favour = hidden = False
    for key, a, b, c, bare in ATTRIBUTE.findall(rest):
        key, value = key.lower(), a or b or c
        hidden |= bool(bare) or key == "aria-hidden" and value == "true"
        hidden |= key == "style" and "display:none" in value.replace(" ", "").lower()
        if key in ("class", "id", "role", "itemprop"):
            for word in [*SPLIT_NAME.split(value), *re.split("[^a-z0-9]+", value.lower())]:
                against |= word.lower() in HINT_AGAINST
                favour |= word.lower() in HINT_FOR
    return against, favour, hidden


def _traits(name: str, rest: str) -> tuple[bool, bool, bool]:
    """Hints of an element. Names on the whole page tell of its parts; what is never shown is hidden."""
    against, favour, hidden = _hints(rest) if rest else (False, False, False)
    return against and name not in ("html", "body"), favour, hidden or name in UNSEEN


def edge_kind(chrome_above: bool, chrome: bool, block: bool) -> str:
    return "in_chrome" if chrome_above else "chrome" if chrome else "block" if block else "plain"


def is_chrome(features: list[float]) -> bool:
    return bool(features[2] or features[3] or features[5])


def element_features(name: str, rest: str, hide: bool = False) -> list[float]:
    against, favour, hidden = _traits(name, rest)
    main = name in NAMED_MAIN and not hide
    return [1.0, float(main), float(name in CHROME), float(against), float(favour and not hide), float(hidden),
            float(name in ("section", "div"))]


def block_features(parent: str, text: str, linked: int) -> list[float]:
    return [1.0, min(math.log1p(text.count(" ") + 1), 4.0), min(1.0, linked / len(text)),
            float(text[-1] in ".!?…\"'”»:;)"), float(parent in ("h1", "h2", "h3", "h4", "h5", "h6")),
            float(parent == "li"), float(parent in ("td", "th")), float(parent in ("div", "body", "section", "#root"))]


def labels_of(dom: Dom) -> list[bool] | None:
    """Content states of a page whose markup names its main part; None for other pages."""
    state: list[bool] = []
    named = False
    for i, (name, rest) in enumerate(dom.names):
        if i == 0:
            state.append(False)
            continue
        above = state[dom.parent[i]]
        against, favour, hidden = _traits(name, rest)
        main = name in NAMED_MAIN or 'role="main"' in rest
        # an article named like a comment or teaser within the main part is none; elsewhere the markup outweighs names
        if name in CHROME or hidden or against and not (main and (favour or not above or name != "article")):
            state.append(False)
        elif main:
            # an article below chrome (a reader's comment, a teaser) is not the main part
            outer = dom.parent[i]
            clear = True
            while outer > 0 and clear:
                up, text = dom.names[outer]
                clear = up not in CHROME and (state[outer] or not _traits(up, text)[0]) and not _traits(up, text)[2]
                outer = dom.parent[outer]
            state.append(clear)
            named |= clear
        else:
            state.append(above)
    return state if named else None


def _fit_weights(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Logistic regression drawn to the prior weights, by Newton steps; labels are weighed to equal shares."""
    w = prior.copy()
    if not len(x):
        return w
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (y - p)) - PRIOR_PRECISION * (w - prior)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + PRIOR_PRECISION * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(pages: list[str]) -> dict:
    """Potentials from the pages that label themselves."""
    elements, blocks, element_y, block_y = [], [], [], []
    pairs = {kind: np.zeros((2, 2)) for kind in PAIR_PRIOR}
    for k, page in enumerate(pages):
        dom = Dom(page)
        state = labels_of(dom)
        if state is None:
            continue
        text = {node: (t, linked) for node, t, linked in dom.blocks}
        chrome = [False]
        plain = k % 3 == 1
        for i in range(1, len(dom.parent)):
            up, (name, rest) = dom.parent[i], dom.names[i]
            around = "div" if plain and dom.names[up][0] == "p" else dom.names[up][0]
            chrome.append(i not in text and is_chrome(element_features(name, rest)))
            pairs[edge_kind(chrome[up], chrome[i], i in text)][int(state[up]), int(state[i])] += 1
            if i in text:
                blocks.append(block_features(around, *text[i]))
                block_y.append(state[i])
            else:
                elements.append(element_features(name, rest, hide=k % 2 == 1))
                element_y.append(state[i])
    tables = {}
    for kind, seen in pairs.items():
        rows = seen.sum(axis=1, keepdims=True)
        seen = PAIR_PRIOR[kind] + seen * np.minimum(1, PAIR_COUNT / np.maximum(rows, 1))
        tables[kind] = (seen / seen.sum(axis=1, keepdims=True)).tolist()
    return {
        "element": _fit_weights(np.array(elements), np.array(element_y, float), ELEMENT_PRIOR).tolist(),
        "block": _fit_weights(np.array(blocks), np.array(block_y, float), BLOCK_PRIOR).tolist(),
        "pairs": tables,
    }


def _odds(weights: list[float], features: list[float]) -> float:
    return math.exp(max(-30.0, min(30.0, sum(map(float.__mul__, weights, features)))))


def marginals(parent: list[int], odds: list[float], pairs: list[list[list[float]]]) -> list[float]:
    """Odds of state 1 at each node of a tree given node odds and each node's (parent, child) potential."""
    n = len(parent)
    belief, up = list(odds), [1.0] * n
    for i in range(n - 1, 0, -1):
        (a, b), (c, d) = pairs[i]
        o = belief[i]
        up[i] = (c + d * o) / (a + b * o)  # message to the parent: its odds given all below
        belief[parent[i]] = min(1e60, max(1e-60, belief[parent[i]] * up[i]))
    for i in range(1, n):
        (a, b), (c, d) = pairs[i]
        o = belief[parent[i]] / up[i]  # the parent without what came from here
        belief[i] = min(1e60, max(1e-60, belief[i] * (b + d * o) / (a + c * o)))
    return belief


def main_text(page: str, model: dict, known: dict | None = None) -> str:
    known = {} if known is None else known
    dom = Dom(page)
    if not dom.blocks:
        return ""
    tables = model["pairs"]
    odds = [_odds(model["element"], [1.0] + [0.0] * 6)]
    chrome, pairs = [False], [tables["plain"]]
    text = {i: (t, linked) for i, t, linked in dom.blocks}
    for i in range(1, len(dom.parent)):
        up, key = dom.parent[i], dom.names[i]
        if i in text:
            value = _odds(model["block"], block_features(dom.names[up][0], *text[i])), False
        else:
            value = known.get(key)
            if value is None:
                features = element_features(*key)
                value = _odds(model["element"], features), is_chrome(features)
                if len(known) < 10_000 and len(key[1]) < 200:
                    known[key] = value
        odds.append(value[0])
        chrome.append(value[1])
        pairs.append(tables[edge_kind(chrome[up], value[1], i in text)])
    belief = marginals(dom.parent, odds, pairs)
    return "\n".join(text for i, text, _ in dom.blocks if belief[i] > 1)


def _extract(batches, model: dict):
    import pyarrow as pa

    known: dict = {}
    for batch in batches:
        texts = [main_text(x.as_py(), model, known) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; the model is trained on at most ``sample`` pages first."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    named = rows.where(F.col("html").rlike(NAMES_MAIN) & (F.octet_length("html") <= PAGE_BYTES))
    chosen = named.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    found = named.join(F.broadcast(chosen), named["page_id"].eqNullSafe(chosen["page_id"]), "left_semi").groupBy("page_id").agg(
        F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("html")).toPandas()
    model = train(found.sort_values(["page_id", "html"])["html"].tolist())
    return rows.mapInArrow(partial(_extract, model=model), TEXTS)
