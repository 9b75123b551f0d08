"""Main text of web pages by a recurrent block labeller.

A bidirectional LSTM in numpy reads a page's whole sequence of blocks (hashed tag path, hashed words, figures of the
text) and labels each block as article or not, with all of the page as context. It is trained here, once in a
process, on pages made by a rule: layouts with menus, headers, footers, sidebars, notices, adverts, forms and
comments around an article, under many tag and class names, with labels known by construction.

Defined results: a null or empty page has an empty text and 0 characters; very long pages are labelled in full: both
directions run over stretches of ``STRETCH`` blocks and carry their states from one to the next, which bounds memory and
gives what one run over the whole page would; repeated rows give equal results; a
null id or url is carried; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import common
from geoloom.llm.html_blocks import PATH_BUCKETS, WIDTH, Block, blocks, features

HIDDEN = 24
TRAIN_PAGES = 3000
EPOCHS = 6
STRETCH = 2048
SEED = 7


# --- training pages -------------------------------------------------------------------------------------------

_SYLLABLES = "an the er ing on re ed ti en or st ar al it le es is co de ra ro li ne ta me pa vo su ka mi lu ße ü é ñ ció eau ou ai".split()
#: Everyday words of page furniture. Fixed values.
_MENU = "Home About Contact News Products Services Blog Login Register Search Sitemap Help Shop Cart Archive Topics World Sport".split()
_LINES = {
    "footer": ["© 2024 {n}. All rights reserved.", "Privacy policy · Terms of use · Imprint", "Powered by {n}", "Contact us at info@{n}.example", "© {n} · {s}"],
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "This site uses cookies. Read our privacy policy.", "Subscribe to our newsletter", "You have reached your limit of free articles."],
    "ad": ["Advertisement", "Sponsored: {s}", "{s}", "Buy now and save 20%!", "Ad · {n}", "{s} {s}"],
    "form": ["Your email address", "Name", "Send", "Subscribe", "Password", "Search this site"],
    "comment": ["{n} says:", "Reply", "{s}", "Posted by {n} on 3 May", "Great article! {s}", "Leave a comment", "3 comments"],
    "side": ["Related articles", "{s}", "Most read", "Popular posts", "Tags: {n}, {n}", "Follow us", "Share this on Facebook"],
    "crumb": ["Home > {n} > {n}", "You are here: {n}", "Home / {n}"],
}
#: How pages wrap each part: tag and class or id. Fixed values.
_WRAP = {
    "menu": ["nav", "div.nav", "div.menu", "ul.navigation", "div#main-nav", "div.navbar", "nav.site-nav", "header", "ul.menu"],
    "header": ["header", "div.header", "div#header", "div.site-header", "div.masthead", "div.top-bar", "div.banner"],
    "footer": ["footer", "div.footer", "div#footer", "div.site-footer", "footer.page-footer", "div.copyright", "div.bottom"],
    "notice": ["div.cookie-notice", "div.cookie-banner", "div#gdpr", "div.notice", "div.alert", "div.consent", "section.paywall", "div.popup", "div.modal"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "aside.promo", "div#ad-top", "div.banner-ad", "div.ad-slot", "ins.adsbygoogle", "section.ad"],
    "form": ["form", "form.search", "div.newsletter", "form.login", "div.signup", "form.subscribe", "fieldset"],
    "comment": ["section.comments", "div#comments", "div.comment-list", "ol.commentlist", "div.discussion", "div.comment", "section.responses"],
    "side": ["aside", "div.sidebar", "div#sidebar", "aside.related", "div.widget", "div.related-posts", "section.more", "div.share", "div.social", "div.recommended", "ul.tags"],
    "crumb": ["div.breadcrumb", "nav.breadcrumbs", "ul.breadcrumb", "ol.path"],
    "article": ["article", "div.content", "div.article", "main", "div#content", "div.post", "div.entry-content", "section.story", "div.article-body", "main article", "div.main", "div.text", "div", "section", "div.post-body"],
}
#: What holds an article's text apart from its headline, at times. Fixed values.
_BODY = ["div.entry-content", "div.article-body", "div.post-content", "div.text", "div", "section", "div.body", "div.story-text"]
_OUTER = ["", "div.wrapper", "div#page", "div.container", "div#root div.layout", "section", "div"]


def _open(spec: str) -> tuple[str, str]:
    start, end = "", ""
    for part in spec.split():
        tag, mark, name = part.partition("#") if "#" in part else part.partition(".")
        attr = f' {"id" if mark == "#" else "class"}="{name}"' if name else ""
        start, end = f"{start}<{tag}{attr}>", f"</{tag}>{end}"
    return start, end


class _Maker:
    """Pages with the label of each block, drawn from a seeded random source."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, most: int = 18, style: str = "") -> str:
        words = [self.word() for _ in range(self.r.randint(1, most))]
        if style == "caps":
            words = [f"{w.upper()}!!" for w in words]
        elif style == "marks":
            words = [w + self.r.choice(["$$$", "%%%", "###", "&amp;&amp;&amp;", "***"]) for w in words]
        elif style == "bars":
            words = [x for w in words for x in (w, "|")]
        elif style == "stutter":
            words = [w for w in words for _ in range(4)]
        s = " ".join(words)
        return s[:1].upper() + s[1:] + ("" if style == "bars" else self.r.choice("...!?"))

    def style(self) -> str:
        """Articles are badly written at times: the place in the page tells more than the words."""
        return self.r.choice(["caps", "marks", "bars", "stutter"]) if self.r.random() < 0.3 else ""

    def paragraph(self, style: str = "") -> str:
        n = self.r.choice([1, 1, 1, 2, 3, 5, 8, 12])
        return " ".join(self.sentence(self.r.choice([3, 8, 18]), style) for _ in range(n))

    def filler(self, kind: str) -> str:
        return self.r.choice(_LINES[kind]).format(n=self.word().title(), s=self.sentence(12))

    def part(self, kind: str) -> list[tuple[str, int]]:
        """Pieces of html, each with the label of the block that it makes (-1: makes none)."""
        r = self.r
        start, end = _open(r.choice(_WRAP[kind]))
        out: list[tuple[str, int]] = [(start, -1)]
        if kind == "menu":
            words = [r.choice(_MENU) if r.random() < 0.5 else self.word() for _ in range(r.randint(2, 9))]
            if r.random() < 0.8:
                out += [("<ul>", -1), *((f'<li><a href="/{w}">{w}</a></li>', 0) for w in words), ("</ul>", -1)]
            else:
                out.append((" ".join(f'<a href="/{w}">{w}</a>' for w in words), 0))
        elif kind == "article":
            bad, body = self.style(), _open(r.choice(_BODY)) if r.random() < 0.4 else ("", "")
            if r.random() < 0.8:
                tag = r.choice(["h1", "h1", "h2"])
                out.append((f"<{tag}>{self.sentence(9)}</{tag}>", 1))
            if r.random() < 0.3:
                out.append((f'<p class="{r.choice(["byline", "meta", "lead", "intro"])}">{self.sentence(8)}</p>', 1))
            out.append((body[0], -1))
            for i in range(r.choice([1, 2, 3, 4, 6, 9, 14, 25])):
                p, style = self.paragraph(bad if r.random() < 0.7 else ""), r.random()
                if style < 0.5:
                    out.append((f"<p>{p}</p>", 1))
                elif style < 0.65:
                    out.append((f"<p><b>{p}<br>", 1))
                elif style < 0.72:
                    out.append((f"<p>{self.sentence(6)} <a href='#'>{self.word()}</a> {p}</p>", 1))
                elif style < 0.8:
                    out.append((f"<h2>{self.sentence(6)}</h2>", 1))
                elif style < 0.87:
                    out += [("<ul>", -1), *((f"<li>{self.sentence(9)}</li>", 1) for _ in range(r.randint(1, 5))), ("</ul>", -1)]
                elif style < 0.91:
                    out.append((f"<blockquote>{p}</blockquote>", 1))
                elif style < 0.95:
                    out.append((f"<div>{p}</div>", 1))
                else:
                    out += [("<table><tr>", -1), *((f"<td>{self.sentence(4)}</td>", 1) for _ in range(r.randint(1, 4))), ("</tr></table>", -1)]
                if i and r.random() < 0.06:
                    out += self.part(r.choice(["ad", "side", "notice"]))
            out.append((body[1], -1))
        else:
            few = {"comment": (1, 9), "side": (1, 7), "footer": (1, 4), "form": (1, 4)}.get(kind, (1, 2))
            for _ in range(r.randint(*few)):
                line = self.filler(kind) if kind != "header" else self.sentence(5)
                tag = r.choice(["p", "div", "span", "li", "h3", "a", ""]) if kind != "form" else r.choice(["label", "div", "button", "p"])
                if tag in ("span", "a", "", "label"):
                    out.append((f"<div>{line}</div>", 0) if r.random() < 0.5 else (f"<{tag or 'p'}>{line}</{tag or 'p'}><hr>", 0))
                else:
                    out.append((f"<{tag}>{line}</{tag}>", 0))
            if kind in ("ad", "footer", "notice") and r.random() < 0.5:
                out = [(start, -1), (self.filler(kind), 0)]
        return [*out, (end, -1)]

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        before = [k for k in ("notice", "header", "menu", "crumb", "ad", "form") if r.random() < {"menu": 0.8, "ad": 0.5}.get(k, 0.3)]
        after = [k for k in ("side", "comment", "ad", "form", "footer", "notice") if r.random() < {"footer": 0.8, "side": 0.4, "comment": 0.4}.get(k, 0.2)]
        if r.random() < 0.3:
            r.shuffle(before)
        outer, outer_end = _open(r.choice(_OUTER))
        pieces = [(outer, -1)]
        if r.random() < 0.2 and "side" in after:
            before.append("side")
        for kind in [*before, "article", *after]:
            pieces += self.part(kind)
        pieces.append((outer_end, -1))
        return "<html><head><title>x</title></head><body>" + "".join(p for p, _ in pieces) + "</body></html>", [y for _, y in pieces if y >= 0]


def training_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``n`` made pages as (features, labels). Where broken markup makes blocks other than those planned, it is left out."""
    maker, out = _Maker(seed), []
    while len(out) < n:
        page, labels = maker.page()
        seq = blocks(page)
        if len(seq) == len(labels):
            out.append((features(seq), np.array(labels, np.float32)))
    return out


# --- the network ----------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction over padded batches (time, batch, 4 x hidden), with gates in the order input, forget, cell, output."""

    @staticmethod
    def forward(z: np.ndarray, u: np.ndarray, mask: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None):
        t, b, h4 = z.shape
        h = h4 // 4
        hs, cs, gates = np.zeros((t + 1, b, h), np.float32), np.zeros((t + 1, b, h), np.float32), np.zeros((t, b, h4), np.float32)
        if state:
            hs[0], cs[0] = state
        for i in range(t):
            g = z[i] + hs[i] @ u
            g[:, : 2 * h], g[:, 3 * h :] = _sigmoid(g[:, : 2 * h]), _sigmoid(g[:, 3 * h :])
            g[:, 2 * h : 3 * h] = np.tanh(g[:, 2 * h : 3 * h])
            m = mask[i][:, None]
            c = g[:, h : 2 * h] * cs[i] + g[:, :h] * g[:, 2 * h : 3 * h]
            cs[i + 1] = m * c + (1 - m) * cs[i]
            hs[i + 1] = m * (g[:, 3 * h :] * np.tanh(c)) + (1 - m) * hs[i]
            gates[i] = g
        return hs, cs, gates

    @staticmethod
    def backward(dh_out: np.ndarray, hs, cs, gates, u, mask):
        t, b, h = dh_out.shape
        dz, du = np.zeros_like(gates), np.zeros_like(u)
        dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        for i in range(t - 1, -1, -1):
            m, g = mask[i][:, None], gates[i]
            gi, gf, gc, go = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
            dh = dh + dh_out[i]
            c = gf * cs[i] + gi * gc
            tc = np.tanh(c)
            dcell = m * (dc + dh * go * (1 - tc * tc))
            d = dz[i]
            d[:, :h] = dcell * gc * gi * (1 - gi)
            d[:, h : 2 * h] = dcell * cs[i] * gf * (1 - gf)
            d[:, 2 * h : 3 * h] = dcell * gi * (1 - gc * gc)
            d[:, 3 * h :] = m * dh * tc * go * (1 - go)
            du += hs[i].T @ d
            dh = (1 - m) * dh + d @ u.T
            dc = (1 - m) * dc + dcell * gf
        return dz, du


@dataclass
class BlockLabeller:
    """Weights of the two directions and the output layer."""

    p: dict[str, np.ndarray]

    @classmethod
    def start(cls, seed: int) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        p = {}
        for d in ("f", "b"):
            p[f"w{d}"] = (rng.standard_normal((WIDTH, 4 * h)) * 0.08).astype(np.float32)
            p[f"u{d}"] = (rng.standard_normal((h, 4 * h)) * 0.15).astype(np.float32)
            p[f"c{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        p["v"] = (rng.standard_normal(2 * h) * 0.1).astype(np.float32)
        p["k"] = np.zeros(1, np.float32)
        return cls(p)

    def run(self, x: np.ndarray, mask: np.ndarray):
        """x: (time, batch, width). Returns the logits and what the backward pass needs."""
        p = self.p
        f = Lstm.forward(x @ p["wf"] + p["cf"], p["uf"], mask)
        b = Lstm.forward((x @ p["wb"] + p["cb"])[::-1], p["ub"], mask[::-1])
        h = np.concatenate([f[0][1:], b[0][1:][::-1]], axis=2)
        return h @ p["v"] + p["k"], h, f, b

    def gradients(self, x, y, mask) -> dict[str, np.ndarray]:
        p = self.p
        logits, h, f, b = self.run(x, mask)
        dl = (_sigmoid(logits) - y) * mask / max(mask.sum(), 1)
        g = {"v": np.einsum("tb,tbh->h", dl, h), "k": dl.sum(keepdims=True).reshape(1)}
        dh = dl[:, :, None] * p["v"]
        for d, state, part, m in (("f", f, dh[:, :, :HIDDEN], mask), ("b", b, dh[::-1, :, HIDDEN:], mask[::-1])):
            dz, g[f"u{d}"] = Lstm.backward(part, *state, p[f"u{d}"], m)
            dz = dz if d == "f" else dz[::-1]
            g[f"w{d}"] = x.reshape(-1, WIDTH).T @ dz.reshape(-1, dz.shape[2])
            g[f"c{d}"] = dz.sum(axis=(0, 1))
        return g

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page a flag for each block: is it article. Pages of like length are run together."""
        out = [np.zeros(len(s), bool) for s in pages]
        todo = sorted((i for i, s in enumerate(pages) if 0 < len(s) <= STRETCH), key=lambda i: len(pages[i]))
        for k in range(0, len(todo), 32):
            group = todo[k : k + 32]
            x, mask = _padded([features(pages[i]) for i in group])
            logits = self.run(x, mask)[0]
            for j, i in enumerate(group):
                out[i] = logits[: len(pages[i]), j] > 0
        for i, s in enumerate(pages):
            if len(s) > STRETCH:
                out[i] = self.long_logits(s) > 0
        return out

    def long_logits(self, seq: list[Block]) -> np.ndarray:
        """The logits of a page of any length: a pass from the end for one direction, one from the start for the other."""
        p, total = self.p, sum(len(b.text) for b in seq)
        logits = np.full(len(seq), p["k"][0], np.float32)
        starts = range(0, len(seq), STRETCH)
        for d, v, step, order in (("b", p["v"][HIDDEN:], -1, reversed(starts)), ("f", p["v"][:HIDDEN], 1, starts)):
            state = None
            for a in order:
                x = features(seq[a : a + STRETCH], a, len(seq), total)[::step, None]
                hs, cs, _ = Lstm.forward(x @ p[f"w{d}"] + p[f"c{d}"], p[f"u{d}"], np.ones(x.shape[:2], np.float32), state)
                state = hs[-1], cs[-1]
                logits[a : a + STRETCH] += (hs[1:, 0] @ v)[::step]
        return logits


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, xs))
    x, mask = np.zeros((t, len(xs), WIDTH), np.float32), np.zeros((t, len(xs)), np.float32)
    for j, a in enumerate(xs):
        x[: len(a), j], mask[: len(a), j] = a, 1
    return x, mask


@lru_cache(maxsize=2)
def trained(n_pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BlockLabeller:
    """Adam over made pages; a share of the tag-path features is dropped so that words and context count as well."""
    data = training_pages(n_pages, seed)
    data.sort(key=lambda d: len(d[1]))
    groups = [data[i : i + 32] for i in range(0, len(data), 32)]
    model, rng = BlockLabeller.start(seed), np.random.default_rng(seed)
    mean, square, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = _padded([a for a, _ in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, labels) in enumerate(groups[g]):
                y[: len(labels), j] = labels
            x[:, :, :PATH_BUCKETS] *= rng.random((1, x.shape[1], PATH_BUCKETS)) > 0.08
            grads = model.gradients(x, y, mask)
            step += 1
            rate = 0.01 * (1 if epoch < epochs - 1 else 0.3)
            for k, v in grads.items():
                v = np.clip(v, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                model.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def extract(df: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url", model: BlockLabeller | None = None) -> DataFrame:
    """One row per row of ``df``: page_id, url, text (the article's blocks, one a line), n_chars, n_blocks."""
    spark = df.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model or trained())

    def run(batches):
        for b in batches:
            pages = [blocks(h) for h in b.column(2).to_pylist()]
            flags = shared.value.label(pages)
            texts = ["\n".join(x.text for x, keep in zip(s, f) if keep) for s, f in zip(pages, flags)]
            cols = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, pages), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    kind = df.schema[page_id].dataType.simpleString()
    return df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long")
