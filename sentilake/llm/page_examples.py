"""Small labelled pages: layouts with every kind of page part, filled with words by a rule."""

from __future__ import annotations

import random
import re

SYLLABLES = "ba ce di fo gu la me ni ro su ta ve".split()

#: Layouts. ``[[ ]]`` hold the main text; {pN} is a sentence of N words, {tN} N words, {aN} a link of N words.
LAYOUTS = (
    '<header class="site-header"><a href="/">{t1}</a><nav><ul><li>{a1}</li><li>{a1}</li><li>{a2}</li></ul></nav></header><main>[[<h1>{t5}</h1><p>{p30}</p><p>{p40} {a2} {p9}</p><h2>{t3}</h2><ul><li>{p6}</li><li>{t4}</li></ul><p>{p25}</p>]]</main><aside><h3>{t2}</h3><p>{p14}</p><ul><li>{a5}</li></ul></aside><footer><p>{p12}</p>{a2}</footer>',
    '<div id="nav"><ul><li>{a1}</li><li>{a1}</li></ul></div><div class="cookie-notice"><p>{p22}</p><button>{t1}</button></div><div id="content">[[<h1>{t6}</h1><div>{p18}</div><div>{p3}</div><p>{p35}</p><blockquote>{p16}</blockquote><p>{p8}</p>]]<div class="share">{a1}{a1}</div></div><div id="comments"><h3>{t1}</h3><div class="comment"><p>{p28}</p></div><div class="comment"><p>{p15}</p><p>{p33}</p></div></div><div id="footer">{p9}</div>',
    '<nav>{a1} {a1} {a1}</nav><article>[[<h1>{t7}</h1><p>{p45}</p>]]<div class="ad"><p>{p11}</p></div>[[<p>{p20}</p><table><tr><td>{t2}</td><td>{t1}</td></tr><tr><td>{t3}</td><td>{p5}</td></tr></table><p>{p4}</p>]]</article><section class="related"><h2>{t2}</h2><div>{a6}</div><div>{a7}</div></section><form action="/s"><label>{t2}</label><input><p>{p10}</p></form><footer>{p13}</footer>',
    '<table><tr><td class="menu">{a1}<br>{a2}<br>{a1}</td><td>[[<b>{t4}</b><br>{p50}<br><br>{p30}<br>{t2}<br>{p27}]]</td></tr><tr><td class="copyright">{p7}</td></tr></table>',
    '<div class="topbar">{a2} {a2}</div><div class="wrap"><div class="post">[[<h2>{t5}</h2><p>{p12}</p><p>{p60}</p><ol><li>{p13}</li><li>{p17}</li></ol><h3>{t2}</h3><p>{p21}</p><p>{p2}</p>]]<form class="newsletter"><p>{p16}</p><input></form></div><div class="sidebar"><h4>{t1}</h4><p>{p24}</p><ul><li>{a4}</li><li>{a3}</li></ul></div></div><div class="sponsored"><p>{p20}</p></div><footer>{t6}</footer>',
    "[[<h1>{t3}</h1><p>{p26}</p><p>{p7}</p><pre>{t9}</pre><p>{p31}</p>]]",
    "[[{p12}]]",
    '<div role="banner">{t3}</div><div role="main">[[<h1>{t4}</h1><dl><dt>{t1}</dt><dd>{p9}</dd><dt>{t2}</dt><dd>{p14}</dd></dl><p>{p19}</p>]]</div><div role="complementary"><p>{p17}</p></div><div class="popup"><p>{p13}</p></div><div role="contentinfo"><p>{p11}</p></div>',
)


def _fill(layout: str, rng: random.Random) -> str:
    def word() -> str:
        return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))

    def text(found: re.Match) -> str:
        # A third more or less than the layout says.
        n = max(1, round(int(found[2]) * rng.uniform(0.67, 1.33)))
        words = " ".join(word() for _ in range(n))
        if found[1] == "p":
            return words.capitalize() + "."
        return f'<a href="/{word()}">{words}</a>' if found[1] == "a" else words.capitalize()

    return re.sub(r"\{([pta])(\d+)\}", text, layout)


def labelled_examples(copies: int = 12) -> list[tuple[str, list[tuple[int, int]]]]:
    """(page, spans of its main text) for ``copies`` fillings of every layout; the same ones every time."""
    out = []
    for seed in range(copies):
        rng = random.Random(seed)
        for layout in LAYOUTS:
            filled = "<html><head><title>{t4}</title></head><body>" + layout + "</body></html>"
            pieces = re.split(r"\[\[|\]\]", _fill(filled, rng))
            spans, at = [], 0
            for n, piece in enumerate(pieces):
                if n % 2:
                    spans.append((at, at + len(piece)))
                at += len(piece)
            out.append(("".join(pieces), spans))
    return out
