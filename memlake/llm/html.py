"""Main text of web pages: a recurrent block labeller.

A page is cut into blocks: the text between two block-level tags, with the path of open elements above
it. A bidirectional LSTM reads, for the whole sequence of a page's blocks, hashed vectors of the path
(tags, and words of class, id and role) and of the words, and labels each block as main text or not. It is
trained here, on a bounded hashed sample of pages. Their labels come from the mark-up that names its
purpose (article, nav, footer, class words); training copies rename, drop or insert such names, so
that the network must also go by place and words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.tables import strings

# Elements of HTML by their role for the text.
BLOCK_TAGS = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p
pre search section select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = set("script style template svg math noembed noframes".split())
CLOSED_BY = {
    "p": BLOCK_TAGS - {"html", "head", "body", "caption", "legend", "summary", "button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"},
}
SCOPES = set("html body table td th ul ol dl div article section nav aside header footer main form button blockquote".split())

# Names of what is not main text, and of what is.
OTHER_TAGS = set("head title nav header footer aside form button select textarea dialog menu noscript iframe search".split())
OTHER_WORDS = set("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus
footer form header legal login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related replies
reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget""".split())
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = set("article content entry main post story text body".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

Path = tuple[str, ...]


def element(tag: str, attributes: str) -> Path:
    """The tag and the words of its class, id and role, as ``tag`` and ``.word``."""
    out = [tag]
    if "=" in attributes:
        for _, value in NAMES.findall(attributes):
            out += ["." + w.lower() for w in WORD.findall(value)]
    return tuple(dict.fromkeys(out))


def blocks(html: str | None) -> list[tuple[Path, str]]:
    """(path, text) of every block with text, in page order, over the whole page.

    Character references are decoded and white space is one blank. Comments, scripts, styles and
    templates are no text. Ends that are missing, misplaced or cut off are tolerated.
    """
    html = html or ""
    stack: list[tuple[str, Path]] = []
    found: list[tuple[Path, str]] = []
    held: list[str] = []
    held_path: Path = ()
    known: dict[tuple, Path] = {}

    def flush():
        if held:
            text = " ".join("".join(held).split())
            if text:
                found.append((held_path, text))
            held.clear()

    def say(raw: str):
        nonlocal held_path
        if not held or not held_path:
            if raw.isspace() and not held:
                return
            key = tuple(e for _, e in stack)
            held_path = known.get(key) or known.setdefault(key, tuple(w for e in key for w in e))
        held.append(unescape(raw) if "&" in raw else raw)

    at = 0
    size = len(html)
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            say(html[at:])
            break
        if mark > at:
            say(html[at:mark])
        m = TOKEN.match(html, mark)
        if m is None:
            say("<")
            at = mark + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            if tag in BLOCK_TAGS or tag == "br":
                flush() if tag != "br" else say(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES and tag not in SCOPES:
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in HIDDEN_TAGS:
            if attributes.endswith("/") and tag in ("svg", "math"):
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if tag in CLOSED_BY.get(stack[k][0], ()):
                    del stack[k:]
                    if stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                        continue
                    break
                if stack[k][0] in SCOPES and stack[k][0] not in CLOSED_BY:
                    break
        if tag in VOID_TAGS:
            continue
        stack.append((tag, element(tag, attributes)))
        if tag in ("textarea", "title"):  # only their own end tag ends them
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            say(html[at:end.start() if end else size])
            flush()
            stack.pop()
            at = end.end() if end else size
    flush()
    return found


def marked(page: list[tuple[Path, str]]) -> np.ndarray:
    """Labels of the sample, from names in the mark-up: what is named as main text and not as anything else.

    Where a page names no main text, paragraphs that nothing names otherwise are.
    """
    other = [any(w in OTHER_TAGS or w[:1] == "." and w[1:] in OTHER_WORDS for w in path) for path, _ in page]
    main = [any(w in MAIN_TAGS or w[:1] == "." and w[1:] in MAIN_WORDS for w in path) for path, _ in page]
    if not any(m and not o for m, o in zip(main, other)):
        main = ["p" in path for path, _ in page]
    return np.array([m and not o for m, o in zip(main, other)], bool)


# The network.

PATH_DIM, WORD_DIM, HIDDEN = 192, 48, 24
DIM = PATH_DIM + WORD_DIM + 2
TRAIN_PAGES, TRAIN_BLOCKS, EPOCHS, RATE = 240, 120, 10, 0.01


class Vectors:
    """Hashed vectors of blocks; paths and words are hashed once, in a memory of bounded size."""

    def __init__(self):
        self.paths: dict[Path, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: Path) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            found = np.zeros(PATH_DIM, np.float32)
            for w in path:
                h = zlib.crc32(w.encode("utf-8", "replace"))
                found[h % PATH_DIM] += 1 if h >> 31 else -1
            self.paths[path] = found = np.clip(found, -2, 2)
        return found

    def __call__(self, page: list[tuple[Path, str]]) -> np.ndarray:
        out = np.zeros((len(page), DIM), np.float32)
        if len(self.words) > 300_000:
            self.words.clear()
        for i, (path, text) in enumerate(page):
            out[i, :PATH_DIM] = self.path(path)
            words = text.split(" ")
            try:
                spots = [self.words[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in self.words:
                        self.words[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) % WORD_DIM
                spots = [self.words[w] for w in words]
            out[i, PATH_DIM:PATH_DIM + WORD_DIM] = np.bincount(spots, minlength=WORD_DIM) / len(words) ** 0.5 * 0.5
            out[i, -2] = np.log1p(len(words)) / 4
            out[i, -1] = 1 if text[-1] in ".!?:" else 0
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_net(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net = {"out": rng.normal(0, 0.3, 2 * HIDDEN), "out_bias": np.zeros(1)}
    for side in "fb":
        net[f"w{side}"] = rng.normal(0, 0.1, (DIM, 4 * HIDDEN))
        net[f"u{side}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        net[f"b{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])  # remember at first
    return {k: v.astype(np.float32) for k, v in net.items()}


def _run(net, side, x, mask, keep=False):
    """States of one direction over (pages, blocks, DIM); padding carries the state on."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    inputs = x @ net[f"w{side}"] + net[f"b{side}"]
    states, tape = np.zeros((n, steps, HIDDEN), np.float32), []
    for t in range(steps):
        z = inputs[:, t] + h @ net[f"u{side}"]
        gates = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        on = mask[:, t, None]
        new_c = f * c + i * g
        bent = np.tanh(new_c)
        if keep:
            tape.append((h, c, i, f, o, g, bent))
        c = np.where(on, new_c, c)
        h = np.where(on, o * bent, h)
        states[:, t] = h
    return states, tape


def _back(net, side, x, mask, tape, d_states):
    """Gradients of one direction from those of its states, back through time."""
    u = net[f"u{side}"]
    dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros_like(tape[0][0]), np.zeros_like(tape[0][0])
    for t in range(x.shape[1] - 1, -1, -1):
        h, c, i, f, o, g, bent = tape[t]
        on = mask[:, t, None]
        dh = dh + d_states[:, t]
        dn, dcn = np.where(on, dh, 0), np.where(on, dc, 0)
        dcn = dcn + dn * o * (1 - bent * bent)
        dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dn * bent * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
        dz_all[:, t] = dz
        du += h.T @ dz
        dh = np.where(on, dz @ u.T, dh)
        dc = np.where(on, dcn * f, dc)
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return {f"w{side}": x.reshape(-1, DIM).T @ flat, f"u{side}": du, f"b{side}": flat.sum(axis=0)}


def _flip(a, lengths):
    """Each page's blocks in reverse, padding left at the end."""
    at = np.arange(a.shape[1])[None, :]
    back = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(a, back[..., None], axis=1)


def _padded(rows: list[np.ndarray]):
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), lengths.max(), DIM), np.float32)
    for k, r in enumerate(rows):
        x[k, :len(r)] = r
    return x, lengths, np.arange(x.shape[1])[None, :] < lengths[:, None]


def predict(net, rows: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of main text for every block of every page, read in both directions."""
    x, lengths, mask = _padded(rows)
    ahead, _ = _run(net, "f", x, mask)
    back, _ = _run(net, "b", _flip(x, lengths), mask)
    logits = ahead @ net["out"][:HIDDEN] + _flip(back, lengths) @ net["out"][HIDDEN:] + net["out_bias"]
    return [_sigmoid(logits[k, :n]) for k, n in enumerate(lengths)]


def _gradients(net, rows, labels):
    x, lengths, mask = _padded(rows)
    turned = _flip(x, lengths)
    ahead, tape_f = _run(net, "f", x, mask, True)
    back, tape_b = _run(net, "b", turned, mask, True)
    both = np.concatenate([ahead, _flip(back, lengths)], axis=2)
    y = np.zeros(mask.shape, np.float32)
    for k, lab in enumerate(labels):
        y[k, :len(lab)] = lab
    error = np.where(mask, _sigmoid(both @ net["out"] + net["out_bias"]) - y, 0) / len(rows)
    d_both = error[..., None] * net["out"]
    grads = {"out": (both * error[..., None]).sum(axis=(0, 1)), "out_bias": error.sum(keepdims=True).reshape(1)}
    grads |= _back(net, "f", x, mask, tape_f, d_both[..., :HIDDEN])
    grads |= _back(net, "b", turned, mask, tape_b, _flip(d_both[..., HIDDEN:], lengths))
    return grads


MADE_UP = [  # what training pages get inserted, as paths below the body
    ("header",), ("div", ".header"), ("header", ".masthead", "h2"), ("div", ".top", ".menu", "ul", "li"), ("nav", "ul", "li"), ("aside", "p"), ("aside", ".sidebar", "ul", "li"),
    ("div", ".sidebar", "p"), ("div", ".cookie", ".notice", "p"), ("div", ".notice"), ("section", ".comments", "article", ".comment", "p"), ("div", ".comments", "div", ".comment", "p"),
    ("section", ".comments", "ol", "li", ".reply", "p"), ("ol", ".comment", ".list", "li", "p"), ("form", "label"), ("form", ".search", "button"), ("form", "p"), ("form", "textarea"), ("div", ".ad"), ("div", ".advert", "p"), ("div", ".sponsored", "p"),
    ("ins", ".ads"), ("div", ".related", "ul", "li"), ("div", ".newsletter", "p"), ("div", ".share", "a"), ("footer", "p"), ("div", ".footer", "p"), ("div", ".breadcrumb", "span"), ("button",), ("select", "option"), ("dialog", "p"), ("div", ".banner", "p"), ("div", ".popup", "p"),
]
INSIDE = [("div", ".ad"), ("aside", "p"), ("section", ".comments", "p"), ("form", "label"), ("nav", "ul", "li"), ("div", ".share"), ("footer", "p"), ("header", "p"), ("div", ".advert", "p"), ("div", ".notice", "p"), ("div", ".related", "p")]
MAIN_NAMES = [("main",), ("div", ".content"), ("div", ".post", ".body"), ("div", ".article"), ("section", ".entry", ".content"), ("main", "article"), ("div", ".main"), ("article", ".post"), ("div", ".story")]
MAIN_BLOCKS = [("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("pre",), ("table", "tr", "td"), ("figure", "figcaption"), ("div",), ("dl", "dd")]


def varied(page, label, texts: list[str], rng: np.random.Generator):
    """A copy of a page with its containers renamed and parts inserted that are no main text."""
    page = list(page)
    if rng.random() < 0.6:
        name = MAIN_NAMES[rng.integers(len(MAIN_NAMES))]
        page = [(tuple(x for w in path for x in (name if w in MAIN_TAGS else (w,))), text) for path, text in page]
    if rng.random() < 0.5:
        page = [((*path[:-1], *MAIN_BLOCKS[rng.integers(len(MAIN_BLOCKS))]) if on and path[-1:] == ("p",) and rng.random() < 0.3 else path, text) for (path, text), on in zip(page, label)]
    rows = list(zip(page, label))
    take = lambda: texts[rng.integers(len(texts))] if texts else "text"
    body = next((path[:k + 1] for path, _ in page for k, w in enumerate(path) if w == "body"), ("html", "body"))
    for _ in range(rng.integers(0, 5)):
        path = (*body, *MADE_UP[rng.integers(len(MADE_UP))])
        edges = [0, len(rows), *(k for k in range(1, len(rows)) if rows[k][1] != rows[k - 1][1])]
        at = edges[rng.integers(len(edges))]
        rows[at:at] = [((path, take()), False) for _ in range(rng.integers(1, 5))]
    mains = [k for k, r in enumerate(rows) if r[1]]
    if mains and rng.random() < 0.4:
        at = mains[rng.integers(len(mains))]
        inside = rows[at][0][0]
        inside = inside[:max((k + 1 for k, w in enumerate(inside) if w in MAIN_TAGS or w[1:] in MAIN_WORDS), default=len(inside))]
        rows[at:at] = [(((*inside, *INSIDE[rng.integers(len(INSIDE))]), take()), False) for _ in range(rng.integers(1, 4))]
    return [r[0] for r in rows], np.array([r[1] for r in rows], bool)


def fit(pages: list[str], seed: int = 3) -> dict[str, np.ndarray]:
    """Train on the sampled pages and three varied copies of each, by Adam and back-propagation through time."""
    rng = np.random.default_rng(seed)
    vectors, net = Vectors(), new_net(seed)
    cut = [p for p in map(blocks, pages) if p]
    texts = [" ".join(t.split()[:40]) for page in cut for _, t in page][:5000]
    rows, labels = [], []
    for page in cut:
        label = marked(page)
        for turn in range(4):
            some, lab = (page, label) if not turn else varied(page, label, texts, rng)
            at = int(rng.integers(0, max(1, len(some) - TRAIN_BLOCKS + 1)))
            rows.append(vectors(some[at:at + TRAIN_BLOCKS]))
            labels.append(lab[at:at + TRAIN_BLOCKS])
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for epoch in range(EPOCHS):
        # Pages of like length together; the groups in random order.
        order = sorted(range(len(rows)), key=lambda k: (len(rows[k]), rng.random()))
        groups = [order[k:k + 24] for k in range(0, len(order), 24)]
        for g in rng.permutation(len(groups)):
            grads = _gradients(net, [rows[k] for k in groups[g]], [labels[k] for k in groups[g]])
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k, d in grads.items():
                d = np.clip(d, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                net[k] = (net[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def sample(pages: DataFrame, html_col: str, n: int = TRAIN_PAGES, most_chars: int = 200_000) -> list[str]:
    """At most ``n`` different pages of at most ``most_chars`` characters, those first by a hash of the html.

    The hash is cut off first, so that only the sample's pages are moved.
    """
    html = F.col(f"`{html_col}`").cast("string")
    rows = pages.select(html.alias("html"), F.xxhash64(html).alias("h")).where(F.length("html") <= most_chars)
    last = rows.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    few = rows.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("html").alias("html"))
    return [r.html for r in few.orderBy("h").limit(n).collect()]


def texts_of(net, pages: list[list[tuple[Path, str]]], vectors: Vectors) -> list[str]:
    """Main text of each page; pages are read together with others of like length."""
    out = [""] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= 12_000:
            end += 1
        group = order[at:end]
        for k, p in zip(group, predict(net, [vectors(pages[k]) for k in group])):
            out[k] = "\n".join(text for (_, text), on in zip(pages[k], p >= 0.5) if on)
        at = end
    return out


def extract(pages: DataFrame, net: dict[str, np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every row, from its whole html.

    Blocks labelled as main text are joined by line ends, in page order. Null and empty html, and
    pages without main text, give an empty text. Ids and urls pass through, null or repeated.
    """
    sent = pages.sparkSession.sparkContext.broadcast(net)
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, held = Vectors(), sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                piece = b.slice(at, 512)
                found = texts_of(held, [blocks(h) for h in strings(piece.column("html"))], vectors)
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())],
                                                 names=["id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, "id bigint, url string, text string, n_chars bigint")
