"""Training of the block labeller on generated pages: ``python -m skysurvey.llm.html_train``.

Pages are made from random layouts whose parts are known to be article or not: menus,
site headers, notices, adverts, sidebars, share bars, forms, comments and footers in many
namings, or none, around an article of headings, paragraphs, lists, quotes, tables and
captions. Articles stand in article, main, section, div or table-cell elements, paragraphs
in p, div or td, and everything may be nested deep. Words are random syllables and common
short words, so that the labeller learns structure rather than topics; what surrounds
articles often says so in set phrases.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from skysurvey.llm.html_extract import HIDDEN, INPUT, MEASURES, PATH_SIZE, PATHS, WORD_SIZE, WORDS, Encoded, _sigmoid, blocks, encode

ARTICLE, OTHER = "\x01", "\x02"

_SYLLABLES = "th he an in er re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur la el ta ä ü ß é è ê ç ñ ó í ción eau".split()
_NAV = "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs toc pagination pager skip-links site-nav tabs".split()
_HEAD = "header site-header masthead top topbar banner page-header branding logo".split()
_FOOT = "footer site-footer bottom colophon copyright legal page-footer credits".split()
_SIDE = "sidebar aside widget related related-posts side rail recommended popular trending tags archive more-stories".split()
_AD = "ad ads advert advertisement sponsored sponsor promo banner-ad adsbygoogle adbox commercial".split()
_NOTE = "cookie cookies consent notice alert gdpr popup modal message newsletter subscribe signup toolbar overlay paywall".split()
_COMMENT = "comment comments comment-list discussion replies responses respond disqus reader-comments commentary".split()
_SHARE = "share social sharing byline meta author date post-meta buttons follow".split()
_MAIN = "content article post entry story main body text post-content entry-content article-body main-content blog-post page".split()
#: Phrases that surround articles, by the part they stand in.
_PHRASES = {
    "nav": "Home|About|About us|Contact|Contact us|Log in|Sign in|Register|Search|Blog|News|Products|Services|Shop|Cart|Help|FAQ|Support|Archive|Start|Kontakt|Anmelden|Suche|Inicio|Contacto|Buscar|Accueil|Rechercher|Next|Previous|Menu|Sitemap|Careers|Forum|Downloads",
    "foot": "All rights reserved|Privacy policy|Terms of service|Terms and conditions|Cookie settings|Powered by|Imprint|Impressum|Datenschutz|Alle Rechte vorbehalten|Aviso legal|Todos los derechos reservados|Mentions légales|Tous droits réservés|Back to top|Copyright 2019|Copyright 2024|© 2021|Inc.|Ltd.",
    "side": "Related articles|Related posts|Most read|Popular|Trending|Recommended for you|You may also like|More stories|Latest news|Recent posts|Categories|Tags|Archives|About the author|Ähnliche Artikel|Lo más leído|À lire aussi|Read more|See also on this site",
    "ad": "Advertisement|Sponsored|Anzeige|Publicidad|Publicité|Buy now|Save 50%|Limited offer|Free trial|Shop now|Learn more|Click here|Special offer|Sale ends soon",
    "note": "We use cookies|This site uses cookies|Accept|Accept all|Decline|Manage preferences|Sign up for our newsletter|Subscribe|Subscribe now|Enter your email|Your email address|Wir verwenden Cookies|Usamos cookies|Nous utilisons des cookies|Get updates in your inbox|Enable JavaScript|Turn off your ad blocker",
    "comment": "Comments|Leave a comment|Leave a reply|Reply|Log in to comment|says|wrote|1 comment|12 comments|Kommentare|Antworten|Comentarios|Responder|Commentaires|Répondre|Report|Like|Great post|Thanks for sharing",
    "share": "Share|Share this|Tweet|Share on Facebook|Follow us|Print|Email|Posted by|Published on|By|Updated|min read|Teilen|Compartir|Partager|Views|Likes",
}
_COMMON = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up what der die und das ist nicht mit den von zu auf für ein eine el la los que en un una por con para le les des est une dans pour pas sur".split()
_NEUTRAL = "wrapper container row col inner box outer section block grid layout left right center".split()


class Maker:
    """A random page, its blocks marked as article or other."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.pool = [self.word() for _ in range(400)] + _COMMON * self.r.choice([0, 1, 3, 6])

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        out = self.r.choices(self.pool, k=self.r.randint(low, high))
        out[0] = out[0].capitalize()
        for i in range(1, len(out)):
            k = self.r.random()
            if k < 0.07:
                out[i - 1] += ","
            elif k < 0.13:
                out[i - 1] += "."
                out[i] = out[i].capitalize()
        if self.r.random() < 0.08:
            out = [w + self.r.choice(["***", "###", "$$$", "%%%", "!!", " |"]) for w in out]
        return " ".join(out)

    def phrase(self, part: str, text: str) -> str:
        """Often a set phrase of a part, alone or before the text."""
        k = self.r.random()
        said = self.r.choice(_PHRASES[part].split("|"))
        return said if k < 0.25 else f"{said} {text}" if k < 0.4 else f"{text} {said}" if k < 0.5 else text

    def sentences(self, low: int, high: int) -> str:
        return self.words(low, high) + self.r.choice([".", ".", ".", "", "!", "?"])

    def pick(self, names: list[str]) -> str:
        """Attributes with one of the names, or none."""
        r = self.r
        k = r.random()
        if k < 0.12:
            return ""
        if k < 0.27:
            return f' {r.choice(["class", "id"])}="{self.code()}"'
        name = r.choice(names) + (r.choice(["", "", "", "-1", "_box", "-wrap", " " + r.choice(_NEUTRAL)]))
        return f' {"id" if k < 0.3 else "class"}="{name}"'

    def code(self) -> str:
        """A name that says nothing."""
        return "".join(self.r.choices("abcdefghijklmnopqrstuvwxyz", k=self.r.randint(1, 3))) + self.r.choice(["", "", str(self.r.randint(1, 99)), "-" + self.word()])

    def nested(self, inner: str, most: int) -> str:
        """inner in some elements that say nothing."""
        r = self.r
        for _ in range(r.choice([0, 0, 0, 1, 1, 2, 3, most])):
            inner = f'<div{r.choice(["", self.pick(_NEUTRAL)])}>{inner}</div>'
        return inner

    def mark(self, kind: str, text: str) -> str:
        return kind + text

    def links(self, kind: str, n: int) -> str:
        r = self.r
        texts = [self.phrase("nav" if kind == OTHER else "side", self.words(1, 3) if r.random() < 0.8 else self.words(3, 9)) for _ in range(n)]
        style = r.random()
        if style < 0.12:
            cells = "".join(f'<td><a href="/{i}">{self.mark(kind, t)}</a></td>' for i, t in enumerate(texts))
            return f"<table><tr>{cells}</tr></table>"
        if style < 0.6:
            return "<ul>" + "".join(f'<li><a href="/{i}">{self.mark(kind, t)}</a></li>' for i, t in enumerate(texts)) + "</ul>"
        if style < 0.8:
            return "".join(f'<div><a href="/{i}">{self.mark(kind, t)}</a></div>' for i, t in enumerate(texts))
        return self.mark(kind, " | ".join(f'<a href="#">{t}</a>' for t in texts))

    def nav(self) -> str:
        tag = self.r.choice(["nav", "nav", "nav", "div", "div", "section"])
        attrs = self.pick(_NAV) if tag != "nav" or self.r.random() < 0.5 else ""
        return f"<{tag}{attrs}>{self.links(OTHER, self.r.randint(2, 12))}</{tag}>"

    def header(self) -> str:
        r = self.r
        tag = r.choice(["header", "header", "div"])
        attrs = self.pick(_HEAD)
        inner = f"<{r.choice(['h1', 'div', 'p', 'h2'])}>{self.mark(OTHER, self.words(1, 4))}"
        if r.random() < 0.5:
            inner += f"<p>{self.mark(OTHER, self.sentences(3, 12))}</p>"
        if r.random() < 0.4:
            inner += self.nav()
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def footer(self) -> str:
        r = self.r
        tag = r.choice(["footer", "footer", "footer", "div", "div", "p"])
        attrs = self.pick(_FOOT)
        inner = ""
        if r.random() < 0.4:
            inner += self.links(OTHER, r.randint(1, 8))
        if r.random() < 0.4:
            inner += f"<div>{self.mark(OTHER, self.phrase('foot', self.sentences(1, 8)))}</div>"
        if r.random() < 0.2:
            inner += self.mark(OTHER, f"{r.choice(['Copyright', '©', '&copy;', '(c)'])} {r.randint(1998, 2026)} {self.words(1, 3)} {r.choice(['Inc.', 'Ltd.', 'GmbH', ''])} {r.choice(_PHRASES['foot'].split('|'))}.")
        elif r.random() < 0.9:
            inner += self.mark(OTHER, f"{r.choice(['&copy; ', 'Copyright ', '&copy; 2024 ', ''])}{self.word()}.example.{r.choice(['com', 'net', 'org'])} {r.choice(['&middot;', '|', '-', '.'])} {self.sentences(2, 16)}")
        if r.random() < 0.3:
            inner += f"<p>{self.mark(OTHER, self.sentences(3, 20))}</p>"
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def aside(self, names: list[str], tags: list[str], low: int = 3, high: int = 30, part: str = "side") -> str:
        r = self.r
        tag = r.choice(tags)
        attrs = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if tag != "aside" or r.random() < 0.6 else ""
        k = r.random()
        if k < 0.45:
            inner = self.mark(OTHER, self.phrase(part, self.sentences(low, high)))
        elif k < 0.8:
            inner = f"<h3>{self.mark(OTHER, self.phrase(part, self.words(1, 4)))}</h3>" * (r.random() < 0.6) + "".join(f"<p>{self.mark(OTHER, self.phrase(part, self.sentences(low, high)))}</p>" for _ in range(r.randint(1, 3)))
        else:
            inner = f"<h4>{self.mark(OTHER, self.phrase(part, self.words(1, 3)))}</h4>" + self.links(OTHER, r.randint(2, 8))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def form(self) -> str:
        r = self.r
        inner = "".join(f"<{t}>{self.mark(OTHER, self.phrase("note", self.words(1, 8)))}</{t}>" for t in r.choices(["p", "div", "label", "legend", "h3"], k=r.randint(1, 4)))
        return f'<form action="/x"{self.pick(_NOTE)}>{inner}<input type="text" name="q"><button>{self.mark(OTHER, self.words(1, 2))}</button></form>'

    def comments(self) -> str:
        r = self.r
        tag = r.choice(["section", "div", "aside", "ol", "ul"])
        name = r.choice(_COMMENT)
        one = r.choice(["div", "li", "article", "p"]) if tag not in ("ol", "ul") else "li"
        out = f"<h3>{self.mark(OTHER, self.phrase('comment', self.words(1, 3)))}</h3>" if r.random() < 0.7 else ""
        for _ in range(r.randint(1, 7)):
            text = self.sentences(2, 50)
            own = f' class="{r.choice(_COMMENT)}"' if r.random() < 0.7 else ""
            if r.random() < 0.2:
                text = self.phrase("comment", text)
            if one == "p" or r.random() < 0.4:
                out += f"<{one}{own}>{self.mark(OTHER, text)}</{one}>"
            else:
                out += f"<{one}{own}><{r.choice(['b', 'h4', 'div', 'cite'])}>{self.mark(OTHER, self.words(1, 2))}</{'b'}><p>{self.mark(OTHER, text)}</p></{one}>"
        return f'<{tag} {r.choice(["class", "id"])}="{name}">{out}</{tag}>'

    def body(self) -> str:
        r = self.r
        title = self.words(2, 12)
        out = ""
        para = r.choice(["p"] * 7 + ["div", "div", "section"])  # what paragraphs stand in
        if r.random() < 0.9:
            h = f"<h1>{self.mark(ARTICLE, title)}</h1>"
            out += f"<header>{h}</header>" if r.random() < 0.12 else h
        if r.random() < 0.15:
            out += f'<{r.choice(["p", "div"])} class="{r.choice(_SHARE)}">{self.mark(OTHER, self.phrase("share", self.words(2, 7)))}</{r.choice(["p", "div"])}>'
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14, 25])):
            k = r.random()
            if k < 0.72:
                text = self.sentences(1, r.choice([4, 12, 30, 60, 150]))
                if r.random() < 0.12:
                    out += f"<p><b>{self.mark(ARTICLE, text)}<br>"
                else:
                    if r.random() < 0.2:
                        text = f'{text} <a href="/l">{self.words(1, 3)}</a> <em>{self.words(1, 2)}</em> {self.words(1, 5)}'
                    end = "</p>" * (r.random() < 0.92) if para == "p" else f"</{para}>"
                    own = self.pick(_NEUTRAL) if para != "p" and r.random() < 0.5 else ""
                    out += f"<{para}{own}>{self.mark(ARTICLE, text)}{end}"
            elif k < 0.82:
                h = r.choice(["h2", "h3", "h4"])
                out += f"<{h}>{self.mark(ARTICLE, self.words(1, 8))}</{h}>"
            elif k < 0.87:
                t = r.choice(["ul", "ol"])
                out += f"<{t}>" + "".join(f"<li>{self.mark(ARTICLE, self.sentences(2, 14))}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>"
            elif k < 0.91:
                out += f"<blockquote>{self.mark(ARTICLE, self.sentences(5, 30))}</blockquote>"
            elif k < 0.93:
                out += "<table>" + "".join("<tr>" + "".join(f"<td>{self.mark(ARTICLE, self.words(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
            elif k < 0.95:
                out += f"<figure><img src=x><figcaption>{self.mark(ARTICLE, self.sentences(3, 12))}</figcaption></figure>"
            elif k < 0.96:
                out += f"<pre>{self.mark(ARTICLE, self.words(3, 20))}</pre>"
            elif k < 0.98:
                out += self.aside(_AD, ["div", "div", "aside", "section"], part="ad")
            else:
                out += self.aside(_SIDE + _NOTE, ["div", "aside"], 3, 15)
        if r.random() < 0.1:
            out += f'<div class="{r.choice(_SHARE)}">{self.links(OTHER, r.randint(2, 5))}</div>'
        if r.random() < 0.08:
            out += self.comments()
        tag = r.choice(["article", "article", "article", "article", "main", "div", "div", "div", "section"])
        attrs = self.pick(_MAIN) if tag in ("div", "section") or r.random() < 0.5 else ""
        out = self.nested(out, 6)
        if r.random() < 0.07:  # an article in no element of its own
            return out
        return f"<{tag}{attrs}>{out}</{tag}>" if r.random() < 0.95 else f"<{tag}{attrs}>{out}"

    def page(self) -> str:
        r = self.r
        before = [self.header] * (r.random() < 0.5) + [self.nav] * (r.random() < 0.85)
        extra = [lambda: self.aside(_AD, ["div", "div", "aside", "section", "p"], part="ad")] * r.choice([0, 1, 1, 2]) + [lambda: self.aside(_NOTE, ["div", "section", "p", "aside"], 3, 40, "note")] * (r.random() < 0.35)
        side = [lambda: self.aside(_SIDE, ["aside", "aside", "div", "section"])] * r.choice([0, 0, 1, 2]) + [self.form] * (r.random() < 0.25)
        r.shuffle(extra)
        top = [f() for f in before + extra]
        if r.random() < 0.2:
            r.shuffle(top)
        late = [f() for f in side] + [self.comments()] * (r.random() < 0.35)
        r.shuffle(late)
        early = [late.pop()] if late and r.random() < 0.25 else []
        body = self.body() if r.random() < 0.97 else ""
        foot = self.footer() if r.random() < 0.9 else ""
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        if r.random() < 0.17:  # a layout by tables
            row = lambda *cells: "<tr>" + "".join(f"<td{self.pick(_NEUTRAL)}>{x}</td>" for x in cells if x) + "</tr>"
            middle = row("".join(early), body, "".join(late)) if r.random() < 0.7 else row("".join(top), body) + row("".join(late))
            rows = [row(x) for x in top] * (r.random() < 0.8) + [middle] + [row(foot)]
            return f"<html>{head}<body>{self.nested('<table>' + ''.join(rows) + '</table>', 3)}</body></html>"
        core = "".join(self.nested(x, 5) for x in early) + self.nested(body, 8) + "".join(self.nested(x, 5) for x in late)
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            core = f'<div{self.pick(_NEUTRAL)}>{core}</div>'
        top = [self.nested(x, 5) for x in top]
        foot = self.nested(foot, 5)
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(top)}<!-- c -->{core}{foot}</body></html>"


def example(seed: int) -> tuple[Encoded, np.ndarray]:
    """A generated page and its blocks' labels."""
    found = blocks(Maker(seed).page())
    labels = np.array([ARTICLE in b.text for b in found], np.float32)
    clean = [b._replace(text=(t := b.text.replace(ARTICLE, "").replace(OTHER, "")) or "x", linked=min(b.linked, len(t))) for b in found]
    return encode(clean), labels


class Trainer:
    """Adam on the cross-entropy of block labels, with back-propagation through time."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        f = lambda *s, k=0.3: (r.normal(size=s) * k).astype(np.float64)
        self.w = {"paths": f(PATHS, PATH_SIZE), "words": f(WORDS, WORD_SIZE, k=0.05), "v": f(2 * HIDDEN + INPUT), "d": np.zeros(())}
        for k in "fb":
            self.w |= {f"w{k}": f(INPUT, 4 * HIDDEN, k=0.2), f"u{k}": f(HIDDEN, 4 * HIDDEN, k=0.2), f"b{k}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        self.m = {k: np.zeros_like(x) for k, x in self.w.items()}
        self.s = {k: np.zeros_like(x) for k, x in self.w.items()}
        self.t = 0

    def _mean(self, n: int, rows: np.ndarray, of: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = np.zeros((n, table.shape[1]))
        np.add.at(out, of, table[rows])
        return out / np.bincount(of, minlength=n)[:, None]

    def step(self, batch: list[tuple[Encoded, np.ndarray]], rate: float) -> float:
        w = self.w
        g = {k: np.zeros_like(x) for k, x in w.items()}
        time, n = max(len(y) for _, y in batch), len(batch)
        x, y, mask = np.zeros((time, n, INPUT)), np.zeros((time, n)), np.zeros((time, n))
        for i, (p, labels) in enumerate(batch):
            k = len(labels)
            x[:k, i] = np.concatenate([self._mean(k, p.paths, p.path_of, w["paths"]) * 3, self._mean(k, p.words, p.word_of, w["words"]) * 3, p.measures], axis=1)
            y[:k, i], mask[:k, i] = labels, 1
        states, tapes = [], []
        for k, flip in (("f", 1), ("b", -1)):
            h, c, tape, out = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), [], np.zeros((time, n, HIDDEN))
            for t in range(time)[::flip]:
                z = x[t] @ w["w" + k] + h @ w["u" + k] + w["b" + k]
                i, f, o = (_sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
                a = np.tanh(z[:, 3 * HIDDEN :])
                m = mask[t][:, None]
                cell = f * c + i * a
                tape.append((t, h, c, i, f, o, a, np.tanh(cell), m))
                h, c = np.where(m > 0, o * tape[-1][7], h), np.where(m > 0, cell, c)
                out[t] = h
            states.append(out)
            tapes.append(tape)
        top = np.concatenate([*states, x], axis=2)
        p = _sigmoid(top @ w["v"] + w["d"])
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / mask.sum()
        err = mask * (p - y) / mask.sum()
        g["v"], g["d"] = np.einsum("tn,tnk->k", err, top), err.sum()
        back = err[:, :, None] * w["v"]
        dx = back[:, :, 2 * HIDDEN :].copy()
        for k, tape, part in (("f", tapes[0], back[:, :, :HIDDEN]), ("b", tapes[1], back[:, :, HIDDEN : 2 * HIDDEN])):
            dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for t, h, c, i, f, o, a, tc, m in reversed(tape):
                dh = dh + part[t]
                do, dcell = dh * tc, dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dcell * a * i * (1 - i), dcell * c * f * (1 - f), do * o * (1 - o), dcell * i * (1 - a * a)], axis=1) * m
                g["w" + k] += x[t].T @ dz
                g["u" + k] += h.T @ dz
                g["b" + k] += dz.sum(axis=0)
                dx[t] += dz @ w["w" + k].T
                dh, dc = np.where(m > 0, dz @ w["u" + k].T, dh), np.where(m > 0, dcell * f, dc)
        for i, (p, labels) in enumerate(batch):
            d = dx[: len(labels), i]
            for name, rows, of, low, high in (("paths", p.paths, p.path_of, 0, PATH_SIZE), ("words", p.words, p.word_of, PATH_SIZE, PATH_SIZE + WORD_SIZE)):
                np.add.at(g[name], rows, (d[:, low:high] * 3 / np.bincount(of, minlength=len(labels))[:, None])[of])
        self.t += 1
        for k in w:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.s[k] = 0.999 * self.s[k] + 0.001 * g[k] ** 2
            decay = 1e-4 * w[k] if k != "words" else 2e-3 * w[k]
            w[k] = w[k] - rate * (self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8) + decay)
        return float(loss)


def train(pages: int = 9000, epochs: int = 4, batch: int = 32, seed: int = 1) -> dict[str, np.ndarray]:
    trainer = Trainer(seed)
    data = [x for x in map(example, range(pages)) if len(x[1])]
    r = random.Random(seed)
    steps = epochs * len(data) // batch
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i: len(data[i][1]) + r.random() * 10)
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        r.shuffle(groups)
        losses = [trainer.step([data[i] for i in g], 0.01 * (1 - 0.95 * min(1, trainer.t / steps))) for g in groups]
        print(epoch, sum(losses) / len(losses), flush=True)
    return trainer.w


if __name__ == "__main__":
    found = train()
    np.savez_compressed(Path(__file__).with_name("html_model.npz"), **{k: x.astype(np.float16) for k, x in found.items()})
