"""Pages written by hand, in layouts unlike the generator's: the blocks between [ and ] are the article."""

import re

import numpy as np

from skysurvey.llm import html_extract as H

STORIES = [
    ("Harbour bridge to close for repairs", "The bridge over the old harbour will close on Monday for six weeks while engineers replace the worn deck plates.", "Ferries will run every twenty minutes during the work, the port authority said, and buses will be sent round by the tunnel.", "Traders on the quay fear that the summer season will be lost."),
    ("How to keep bread fresh", "Bread goes stale because its starch slowly turns back into crystals, and cold speeds that up.", "Wrap a loaf in a linen cloth, store it in a wooden box, and slice only what you need.", "Stale bread is best toasted or turned into crumbs."),
    ("A short history of the bicycle", "The first machine with two wheels in a line was built in 1817 and had no pedals at all.", "Pedals came in the sixties of that century, the chain in the eighties, and with the air-filled tyre riding became a pleasure.", "Ten years later there were bicycles in every town."),
    ("Notes on the night sky in October", "Saturn stands low in the south after dusk and sets shortly before midnight.", "With a small telescope one sees its rings as a thin bright line this year.", "The meteors of the Orionids are at their best on the 21st."),
    ("Ein Garten ohne Wasser", "Wer im Sommer nicht gießen will, wählt Pflanzen, die aus trockenen Ländern kommen, und deckt den Boden mit Kies ab.", "Lavendel, Salbei und Thymian kommen mit sehr wenig Regen aus und blühen trotzdem lange.", "Nach zwei Jahren braucht ein solches Beet keine Pflege mehr."),
    ("El mercado de los viernes", "Cada viernes por la mañana los agricultores del valle bajan al pueblo con sus verduras y sus quesos.", "Los precios son bajos, porque no hay intermediarios, y la gente llega desde muy lejos.", "Al mediodía ya no queda casi nada."),
    ("Des abeilles sur les toits", "Depuis dix ans, des ruches sont installées sur les toits de plusieurs théâtres de la ville.", "Les abeilles y trouvent des fleurs du printemps à l'automne et donnent un miel très clair.", "Chaque année on en récolte près de trois cents kilos."),
    ("Why tides are late", "A tide does not follow the moon at once, since water has to flow round the land and is slowed by the shallow shelf.", "In some bays the delay is half a day, in others it is hardly an hour.", "Tables for each port are made from long records."),
]

LAYOUTS = [
    "<body><nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></article><footer>Copyright 2024 Acme Inc. All rights reserved.</footer></body>",
    "<body><div class=top><a href=/>Home</a></div><div class=entry><h1>[T]</h1><div>[A]</div><div>[B]</div><div>[C]</div></div><div id=ft>Copyright 2024 Acme Inc. All rights reserved.</div></body>",
    "<body><main><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></main><aside><h3>Related articles</h3><ul><li><a href=1>Seven ways to save</a></li><li><a href=2>What we know</a></li></ul></aside></body>",
    "<body><table width=100%><tr><td colspan=2>The Daily Gull</td></tr><tr><td><a href=1>News</a><br><a href=2>Sport</a><br><a href=3>Weather</a></td><td><h2>[T]</h2><p>[A]</p><p>[B]</p><p>[C]</p></td></tr><tr><td colspan=2>&copy; 2003 The Daily Gull</td></tr></table></body>",
    "<body><table class=menu><tr><td><a href=1>Home</a></td><td><a href=2>Products</a></td><td><a href=3>Contact</a></td></tr></table><article><h1>[T]</h1><p>[A]</p><p>[B]</p></article></body>",
    "<body><div><div><div><div><div><div><section><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></section></div></div></div></div></div></div><footer><a href=/p>Privacy policy</a> | <a href=/t>Terms</a></footer></body>",
    "<body><header><h1>Acme Blog</h1><p>Thoughts on tools</p></header><article><h2>[T]</h2><p>[A]</p><p>[B]</p><p>[C]</p></article><section class=comments><h3>3 comments</h3><div><b>Tom</b><p>Great post, thanks!</p></div><div><b>Ann</b><p>I do not agree with you at all on this.</p></div></section></body>",
    "<body><div id=wrap><div id=menu><ul><li><a href=1>Start</a></li><li><a href=2>Kontakt</a></li></ul></div><div id=content><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></div><div id=bottom>Impressum | Datenschutz</div></div></body>",
    "<body><div class=cookie-banner>We use cookies to improve this site. <button>Accept</button></div><main><article><h1>[T]</h1><p>[A]</p><blockquote>[B]</blockquote><p>[C]</p></article></main></body>",
    "<body><div class=post><h1 class=post-title>[T]</h1><div class=meta>Posted by Jane on 3 May</div><div class=post-body><p>[A]</p><p>[B]</p><p>[C]</p></div></div><div class=sidebar><h4>Categories</h4><ul><li><a href=1>Travel</a><li><a href=2>Food</a></ul></div></body>",
    "<body><article><h1>[T]</h1><p>[A]<p>[B]<p>[C]</article><form><label>Subscribe to our newsletter</label><input><button>Sign up</button></form></body>",
    "<body><nav><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></nav><main><h1>[T]</h1><p>[A]</p><h2>[B]</h2><p>[C]</p></main></body>",
    "<body><div class=header>City News</div><div class=nav><a href=1>Local</a> | <a href=2>World</a></div><div class=story><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></div><div class=ad>Advertisement. Buy now and save 50%.</div><div class=footer>All rights reserved</div></body>",
    "<body><section id=main-content><h1>[T]</h1><p>[A]</p><div class=advert>Sponsored: the best shoes of the year</div><p>[B]</p><p>[C]</p></section></body>",
    "<body><article><header><h1>[T]</h1></header><p>[A]</p><ul><li>[B]</li><li>[C]</li></ul></article><aside class=related><h3>You may also like</h3><p><a href=1>Another story of the sea</a></p></aside></body>",
    "<body><div role=navigation><a href=1>Home</a><a href=2>Blog</a></div><div role=main><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></div><div role=contentinfo>Powered by Acme</div></body>",
    "<body><div class=row><div class=col><h3>Popular</h3><ul><li><a href=1>First link</a></li><li><a href=2>Second link</a></li></ul></div><div class=col><div class=article-text><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></div></div></div></body>",
    "<body><center><table><tr><td><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></td></tr></table><p><a href=/>Home</a> | <a href=/m>Sitemap</a></p></center></body>",
    "<body><div class=page><div class=masthead>The Evening Post</div><div class=body-copy><div>[T]</div><div>[A]</div><div>[B]</div><div>[C]</div></div><div class=legal>Terms and conditions apply. Copyright 2019.</div></div></body>",
    "<body><main><article><h1>[T]</h1><div class=share><a href=1>Share on Facebook</a> <a href=2>Tweet</a></div><p>[A]</p><p>[B]</p><p>[C]</p></article></main><footer><p>About the author: Jane writes on tools.</p><p>All rights reserved.</p></footer></body>",
    "<body><article><h1>[T]</h1><figure><img src=a.jpg><figcaption>[A]</figcaption></figure><p>[B]</p><p>[C]</p></article><div class=discussion><h3>Leave a reply</h3><p>Log in to comment</p></div></body>",
    "<body><div class=x1><a href=1>Home</a></div><div class=x1><a href=2>Shop</a></div><div class=x2><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></div><div class=x3>© 2021 Acme Ltd.</div></body>",
    "<body><header class=site-header><a href=/>Logo</a><nav><a href=1>Services</a><a href=2>Careers</a></nav></header><div class=hero></div><article class=entry-content><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></article><footer class=site-footer>Cookie settings</footer></body>",
    "<body><ul class=breadcrumbs><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><section class=content><h1>[T]</h1><section>[A]</section><section>[B]</section><section>[C]</section></section></body>",
    "<body><div class=modal><h2>Subscribe now</h2><p>Get updates in your inbox</p></div><div class=main><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></div></body>",
    "<body><article><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p><div class=tags><a href=1>sea</a> <a href=2>town</a></div></article><div class=recommended><h3>Recommended for you</h3><ul><li><a href=1>The lighthouse keeper</a></li></ul></div></body>",
    "<html><body><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p><hr><address>Last updated 3 May 1999</address></body></html>",
    "<body><div><ul><li><a href=1>Forum</a></li><li><a href=2>Downloads</a></li><li><a href=3>Help</a></li></ul></div><div><div><h2>[T]</h2><p>[A]</p><p>[B]</p><p>[C]</p></div></div></body>",
    "<body><main><div class=grid><div class=left><nav class=toc><a href=1>Chapter 1</a><a href=2>Chapter 2</a></nav></div><div class=right><article><h1>[T]</h1><p>[A]</p><pre>[B]</pre><p>[C]</p></article></div></div></main></body>",
    "<body><div class=banner>Sale ends soon! <a href=1>Shop now</a></div><div class=container><div class=blog-post><h2>[T]</h2><p>[A]</p><p>[B]</p><p>[C]</p></div></div><div class=copyright>© 2021</div></body>",
    "<body><article><h1>[T]</h1><table><tr><td>[A]</td><td>[B]</td></tr></table><p>[C]</p></article><footer>Todos los derechos reservados</footer></body>",
    "<body><section class=hero><h1>[T]</h1></section><section class=story-body><p>[A]</p><p>[B]</p><p>[C]</p></section><section class=newsletter><p>Sign up for our newsletter</p></section></body>",
    "<body><div class=wrapper><header>Acme</header><article><h1>[T]</h1><p>[A]</p><aside class=pullquote-ad>Limited offer: free trial</aside><p>[B]</p><p>[C]</p></article><footer>Mentions légales</footer></div></body>",
    "<body><div id=c><div id=c1><div id=c2><h1>[T]</h1><div id=c3><p>[A]</p><p>[B]</p><p>[C]</p></div></div></div></div><div id=r><ol class=comments><li>First!</li><li>Nice one, I have read it twice.</li></ol></div></body>",
    "<body><nav class=pagination><a href=1>Previous</a><a href=2>Next</a></nav><main class=article><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></main><nav class=pagination><a href=1>Previous</a><a href=2>Next</a></nav></body>",
    "<body><article><h1>[T]</h1><p class=lead>[A]</p><p>[B]</p><h3>[C]</h3></article><div class=author>About the author</div><div class=social>Follow us</div></body>",
    "<body><div class=site><div class=site-inner><div class=content-sidebar-wrap><main class=content><article class=post><h1 class=entry-title>[T]</h1><div class=entry-content><p>[A]</p><p>[B]</p><p>[C]</p></div></article></main><aside class=widget-area><h4>Archives</h4><a href=1>May 2020</a></aside></div></div></div></body>",
    "<body><div class=alert>Turn off your ad blocker to read on.</div><article><h1>[T]</h1><p>[A]</p><p>[B]</p><p>[C]</p></article></body>",
    "<body><div class=toolbar><button>Log in</button><button>Register</button></div><div class=text><p>[A]</p><p>[B]</p><p>[C]</p></div><div class=powered>Powered by Acme</div></body>",
    "<body><main><section><h1>[T]</h1><p>[A]</p></section><section><p>[B]</p><p>[C]</p></section></main><section class=responses><h2>Responses</h2><article><p>I was there, it was not so bad.</p></article></section></body>",
    "<body><div class=nav-wrap><select><option>English</option></select><a href=1>Search</a></div><div class=main-story><p>[T]</p><p>[A]</p><p>[B]</p><p>[C]</p></div><div class=foot-note>Privacy policy</div></body>",
    "<body><article><h1>[T]</h1><p>[A] <a href=1>more</a></p><p>[B]</p><p>[C]</p></article><ul class=footer-links><li><a href=1>Imprint</a></li><li><a href=2>Jobs</a></li></ul></body>",
]


def counts():
    right = extra = missed = 0
    whole = 0
    for i, layout in enumerate(LAYOUTS):
        for j in range(3):
            title, *paragraphs = STORIES[(i + 3 * j) % len(STORIES)]
            page = layout
            for mark, text in zip("TABC", (title, *paragraphs)):
                page = page.replace(f"[{mark}]", f"\x01{text}")
            found = H.blocks(page)
            labels = np.array(["\x01" in b.text for b in found])
            clean = [b._replace(text=b.text.replace("\x01", "")) for b in found]
            chosen = H.scores(H.trained(), [H.inputs(H.trained(), H.encode(clean))])[0] >= 0.5
            right += (chosen & labels).sum()
            extra += (chosen & ~labels).sum()
            missed += (~chosen & labels).sum()
            whole += (chosen == labels).all()
            for b, c, y in zip(clean, chosen, labels):
                if c != y:
                    print(i, j, "missed" if y else "extra", b.text[:60])
    return right, extra, missed, whole


def test_layouts_by_hand():
    assert len(LAYOUTS) >= 40 and sum("<article" in x for x in LAYOUTS) <= len(LAYOUTS) / 2
    assert len(set(LAYOUTS)) == len(LAYOUTS) and all(re.search(r"\[A\].*\[B\]", x) for x in LAYOUTS)
    right, extra, missed, _ = counts()
    assert 2 * right / (2 * right + extra + missed) >= 0.9
