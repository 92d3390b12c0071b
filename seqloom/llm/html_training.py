"""Training of the block labeller on seeded page layouts.

Layouts vary where the article stands and what surrounds it: menus, headers, sidebars, adverts, notices, forms, comments and
footers, outside and inside the article, with short and with long texts. Words are invented, so that the place of a block
decides and not its language. Texts of the article start with a mark that is taken off before the model sees them.
"""

from __future__ import annotations

import numpy as np

from seqloom.llm.html_blocks import INPUT_DIM, Features, Labeller, pad, page_blocks

N_PAGES, N_HELD_OUT, EPOCHS, BATCH, HIDDEN, SEED = 2000, 300, 7, 24, 20, 7
MARK = "\x01"
_TRAINED: dict[str, dict[str, np.ndarray]] = {}

BOILERPLATE = ["home", "about", "contact", "login", "subscribe", "newsletter", "share", "tweet", "cookie", "accept", "privacy", "terms",
               "copyright", "rights", "reserved", "advertisement", "sponsored", "related", "comments", "reply", "search", "menu", "next", "previous",
               "datenschutz", "impressum", "anmelden", "accueil", "connexion", "inicio", "buscar"]
AD = ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "adsense", "ad-slot", "sponsor"]
SIDE = ["sidebar", "side-bar", "widget", "widget-area", "related", "related-posts", "recommended", "trending", "popular", "secondary", "rail"]
MENU = ["menu", "nav", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "topbar", "tabs", "pagination", "toc-nav"]
HEAD = ["header", "site-header", "masthead", "page-header", "logo", "branding", "top"]
FOOT = ["footer", "site-footer", "copyright", "bottom", "colophon", "legal", "foot"]
NOTICE = ["cookie", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "message", "newsletter", "paywall", "notification"]
REMARKS = ["comments", "comment", "comment-list", "commentlist", "reply", "replies", "discussion", "responses", "disqus", "reader-comments"]
SHARE = ["share", "social", "social-share", "sharing", "follow", "tags", "author-bio", "byline", "meta"]
BODY = ["content", "main-content", "post", "post-content", "entry", "entry-content", "article", "article-body", "story", "story-body", "text",
        "page-content", "body-text", "blog-post", "primary"]


class _Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        letters = ["ba", "re", "ti", "on", "th", "en", "ou", "la", "se", "du", "ki", "mo", "é", "ü", "ña", "st", "er", "wo", "li", "pa"]
        self.words = ["".join(rng.choice(letters, rng.integers(1, 5))) for _ in range(400)]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def some(self, options: list[str]) -> str:
        return options[self.rng.integers(len(options))]

    def prose(self, low: int, high: int) -> str:
        words = [self.some(self.words) for _ in range(self.rng.integers(low, high))]
        return (" ".join(words)).capitalize() + self.some([".", ".", "", "!", " &amp; " + self.some(self.words) + "."])

    def said(self, low: int, high: int, own: float = 0.3) -> str:
        """Text around an article: its usual words, or prose of any length like the article's."""
        return " ".join(self.some(BOILERPLATE) for _ in range(self.rng.integers(1, 6))) if self.chance(own) else self.prose(low, high)

    def named(self, names: list[str], tags: list[str], inner: str, bare: float = 0.0) -> str:
        tag = self.some(tags)
        if self.chance(bare):
            return f"<{tag}>{inner}</{tag}>"
        name = self.some(names)
        extra = f" {self.some(self.words)}" if self.chance(0.2) else ""
        key = "id" if self.chance(0.3) else "class"
        return f'<{tag} {key}="{name}{extra}">{inner}</{tag}>'

    def links(self) -> str:
        one = [f'<li><a href="/{i}">{self.said(1, 4)}</a></li>' for i in range(self.rng.integers(2, 9))]
        return "<ul>" + "".join(one) + "</ul>" if self.chance(0.8) else " ".join(f'<a href="#">{self.said(1, 3)}</a>' for _ in one)

    def ps(self, n: int, low: int = 3, high: int = 40) -> str:
        return "".join(f"<p>{self.said(low, high)}</p>" if self.chance(0.7) else self.said(low, high) for _ in range(n))

    def main_blocks(self) -> list[str]:
        out = []
        for _ in range(self.rng.integers(1, 14)):
            text = MARK + (self.prose(1, 4) if self.chance(0.15) else self.prose(5, 60))
            kind = self.rng.random()
            if kind < 0.62:
                link = f' <a href="/x">{self.prose(1, 4)}</a> {self.prose(2, 8)}' if self.chance(0.2) else ""
                bold = self.chance(0.15)
                out.append(f"<p>{'<b>' * bold}{text}{link}{self.some(['</b>', '']) * bold}{self.some(['</p>', '</p>', '<br>'])}")
            elif kind < 0.74:
                out.append(f"<{(h := self.some(['h2', 'h3', 'h4']))}>{text}</{h}>")
            elif kind < 0.82:
                items = "".join(f"<li>{MARK}{self.prose(2, 12)}</li>" for _ in range(self.rng.integers(1, 5)))
                out.append(f"<{(t := self.some(['ul', 'ol']))}>{items}</{t}>")
            elif kind < 0.88:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.92:
                out.append(f"<pre><code>{text}</code></pre>")
            elif kind < 0.95:
                out.append("<table><tr>" + "".join(f"<td>{MARK}{self.prose(1, 5)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(f"<div>{text}</div>")
        return out

    def inside(self) -> str:
        """Something that stands within the article and is none of it."""
        return self.some([
            self.named(AD, ["div", "aside", "section"], self.ps(1)), self.named(SHARE, ["div", "ul"], self.links()),
            self.named(SIDE, ["aside", "div"], self.ps(1) + self.links(), 0.0), self.named(NOTICE, ["div"], self.ps(1)),
            f"<form>{self.ps(1, 2, 6)}<label>{self.said(1, 3)}</label><input><button>{self.said(1, 3)}</button></form>",
            f"<aside>{self.ps(1)}</aside>", f"<nav>{self.links()}</nav>", self.named(REMARKS, ["div", "section", "ol"], self.ps(3, 5, 40)),
            f"<footer>{self.ps(1, 2, 10)}</footer>"])

    def page(self) -> str:
        blocks = self.main_blocks()
        for _ in range(self.rng.integers(0, 3) if self.chance(0.35) else 0):
            blocks.insert(int(self.rng.integers(0, len(blocks) + 1)), self.inside())
        title = f"<h1>{MARK}{self.prose(2, 10)}</h1>" if self.chance(0.85) else ""
        if title and self.chance(0.2):
            title = f"<header>{title}</header>"
        inner = title + "".join(blocks)
        shape = self.rng.random()
        if shape < 0.5:
            body = f"<article>{inner}</article>" if self.chance(0.6) else self.named(BODY, ["article"], inner)
        elif shape < 0.65:
            body = f"<main>{inner}</main>" if self.chance(0.5) else f'<div role="main">{inner}</div>'
        elif shape < 0.92:
            body = self.named(BODY, ["div", "section", "div"], inner)
        else:
            body = f"<div>{inner}</div>"
        if self.chance(0.3):
            body = self.named(["container", "wrapper", "page", "site", "layout", "row", "col", "wrap"], ["div"], body)
        before, after = [], []
        if self.chance(0.5):
            before.append(self.named(HEAD, ["header", "div"], self.ps(1, 1, 8) + (self.links() if self.chance(0.4) else ""), 0.0)
                          if self.chance(0.5) else f"<header>{self.ps(1, 1, 12)}</header>")
        if self.chance(0.75):
            before.append(f"<nav>{self.links()}</nav>" if self.chance(0.6) else self.named(MENU, ["nav", "div", "ul"], self.links()))
        if self.chance(0.5):
            before.append(self.named(AD, ["div", "section"], self.said(2, 25) if self.chance(0.6) else self.ps(1)))
        if self.chance(0.3):
            before.append(self.named(NOTICE, ["div", "section"], self.ps(1) + f"<button>{self.said(1, 3)}</button>"))
        if self.chance(0.2):
            before.append(f"<form>{self.said(1, 4)}<input><button>{self.said(1, 2)}</button></form>")
        if self.chance(0.4):
            (after if self.chance(0.6) else before).append(f"<aside>{self.ps(2)}{self.links()}</aside>" if self.chance(0.4)
                                                           else self.named(SIDE, ["div", "aside", "section"], self.ps(2) + self.links()))
        if self.chance(0.35):
            after.append(self.named(REMARKS, ["div", "section", "ol"], "".join(
                self.named(REMARKS, ["div", "li", "article"], self.ps(1, 5, 50), 0.1) for _ in range(self.rng.integers(1, 5)))))
        if self.chance(0.2):
            after.append(self.named(AD, ["div"], self.ps(1)))
        if self.chance(0.2):
            after.append(f"<form>{self.ps(1, 3, 10)}<textarea></textarea><button>{self.said(1, 2)}</button></form>")
        if self.chance(0.2):
            after.append(self.named(NOTICE, ["div"], self.ps(1)))
        foot = [f"<footer>{self.said(3, 25)}</footer>" if self.chance(0.7) else self.named(FOOT, ["footer", "div"], self.ps(1, 3, 20))] if self.chance(0.8) else []
        self.rng.shuffle(before)
        end = "</body></html>" if self.chance(0.85) else ""
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(before)}{body}{''.join(after)}{''.join(foot)}{end}"


def layouts(n: int, seed: int) -> tuple[list, list[np.ndarray]]:
    """Blocks of `n` pages and which of them belong to the article."""
    maker = _Maker(np.random.default_rng(seed))
    pages, labels = [], []
    for _ in range(n):
        blocks = page_blocks(maker.page())
        labels.append(np.array([b.text.startswith(MARK) for b in blocks], np.float32))
        for b in blocks:
            b.text = b.text.replace(MARK, "") or "x"
        pages.append(blocks)
    return pages, labels


def _backward(x, w, u, kept, mask, grad_out):
    """Gradients of one direction from those of its states."""
    size = u.shape[0]
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], np.float32)
    dh, dc = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][1])
    for t in range(len(kept) - 1, -1, -1):
        h, c, i, f, o, g, th = kept[t]
        m = mask[t][:, None]
        total = dh + grad_out[t]
        live, live_c = np.where(m, total, 0), np.where(m, dc, 0)
        d_c = live_c + live * o * (1 - th * th)
        dz = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), live * th * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(axis=0)
        dh = np.where(m, dz @ u.T, total)
        dc = np.where(m, d_c * f, dc)
    return dw, du, db


def train(n_pages: int = N_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights after `epochs` passes of Adam over `n_pages` layouts."""
    rng = np.random.default_rng(seed)
    pages, labels = layouts(n_pages, seed)
    features = Features()
    rows = [features.pages([p]) for p in pages]

    def start(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"v": start(2 * HIDDEN + INPUT_DIM, 1), "c": np.zeros(1, np.float32)}
    for side in "fb":
        p["w" + side], p["u" + side] = start(INPUT_DIM, 4 * HIDDEN), start(HIDDEN, 4 * HIDDEN)
        p["b" + side] = np.zeros(4 * HIDDEN, np.float32)
        p["b" + side][HIDDEN:2 * HIDDEN] = 1
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    by_length = sorted(range(n_pages), key=lambda i: len(rows[i]))
    batches = [b for b in (by_length[i:i + BATCH] for i in range(0, n_pages, BATCH)) if len(rows[b[0]])]
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for k in rng.permutation(len(batches)):
            group = batches[k]
            x, mask = pad([rows[i] for i in group])
            want = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(group):
                want[:len(labels[i]), j] = labels[i]
            score, h, left, right = Labeller(p).forward(x, mask)
            d = (np.where(mask, score - want, 0) / mask.sum())[:, :, None].astype(np.float32)
            grads = {"v": np.tensordot(h, d, ([0, 1], [0, 1])), "c": d.sum(axis=(0, 1))}
            dh = d @ p["v"][:2 * HIDDEN].T
            grads["wf"], grads["uf"], grads["bf"] = _backward(x, p["wf"], p["uf"], left, mask, dh[:, :, :HIDDEN])
            grads["wb"], grads["ub"], grads["bb"] = _backward(x[::-1], p["wb"], p["ub"], right, mask[::-1], dh[::-1, :, HIDDEN:])
            step += 1
            for name, g in grads.items():
                g = np.clip(g, -1, 1) + 1e-6 * p[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                p[name] = (p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def held_out_accuracy(weights: dict[str, np.ndarray], n: int = N_HELD_OUT, seed: int = 99) -> tuple[float, float]:
    """Share of blocks and of whole pages labelled right on layouts not trained on."""
    pages, labels = layouts(n, seed)
    score = Labeller(weights).scores(Features().pages(pages), [len(p) for p in pages])
    right = (score >= 0.5) == (np.concatenate(labels) >= 0.5)
    stops = np.cumsum([len(p) for p in pages])
    return float(right.mean()), float(np.mean([part.all() for part in np.split(right, stops[:-1])]))


def trained() -> dict[str, np.ndarray]:
    """The weights, fitted once per process."""
    if "weights" not in _TRAINED:
        _TRAINED["weights"] = train()
    return _TRAINED["weights"]
