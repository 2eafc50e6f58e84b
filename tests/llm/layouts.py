"""Pages written by hand after common site layouts, with their articles; the operator's training rules don't make these."""

A = "The ferry between the two islands will run every hour from the first of May, the harbour office said on Tuesday."
B = "Until now there were four crossings a day, which left many people waiting on the quay, above all at weekends."
C = "A second boat was bought last autumn. It has room for ninety passengers and eleven cars, and needs a crew of three."
D = "Tickets stay at the old price for those who live here; visitors pay two more."
H = "More ferries from May"
NAV = '<ul id="{}"><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/about">About us</a></li></ul>'
TEXT = " ".join((H, A, B, C, D))

PAGES = {
    "weblog": (
        '<body class="post-template-default single"><div id="page" class="hfeed"><header id="masthead" class="site-header"><p class="site-title">Island News</p><nav class="main-navigation">' + NAV.format("menu-1") + '</nav></header>'
        f'<div id="primary" class="content-area"><main id="main"><article id="post-12" class="post"><header class="entry-header"><h1 class="entry-title">{H}</h1></header><div class="entry-content"><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></div></article>'
        '<div id="comments" class="comments-area"><h2>2 thoughts on this</h2><ol class="comment-list"><li class="comment"><p>Finally! I have waited for this for years, thank you.</p></li><li class="comment"><p>What about bicycles? Nobody ever says a word about them.</p></li></ol></div></main></div>'
        '<aside id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">School fair</a></li><li><a href="/2">New roof</a></li></ul></aside><footer id="colophon" class="site-footer">Proudly made on the islands. &copy; 2020</footer></div></body>', TEXT),
    "bare old page": (f"<html><head><title>{H}</title></head><body bgcolor=white><h1>{H}</h1><p>{A}<p>{B}<p>{C}<p>{D}<hr><address>Webmaster, last changed in April.</address></body></html>", TEXT),
    "main only": (f"<body><header><a href=/>Island News</a></header><main><h1>{H}</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></main><footer><p>&copy; Island News. All rights reserved.</p></footer></body>", TEXT),
    "grid without names": (f'<body><div class="container"><div class="row"><div class="col-md-3">{NAV.format("n")}</div><div class="col-md-9"><h1>{H}</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></div></div><div class="row"><p>&copy; 2021 Island News. All rights reserved.</p></div></div></body>', TEXT),
    "wrappers": (f'<body><div class="wrapper"><div class="col-8"><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></div></div></body>', " ".join((A, B, C, D))),
    "hashed names": (f'<body><div id="root"><div class="sc-1a2b"><nav class="sc-9z"><a href="/">Home</a> <a href="/n">News</a></nav><div class="sc-7k"><h1 class="sc-33">{H}</h1><div class="sc-4f"><p class="sc-p">{A}</p><p class="sc-p">{B}</p><p class="sc-p">{C}</p><p class="sc-p">{D}</p></div></div></div></div></body>', TEXT),
    "wiki": (
        f'<body class="mediawiki"><div id="mw-navigation"><div id="p-navigation"><h3>Navigation</h3>{NAV.format("w")}</div></div><div id="content" class="mw-body"><h1 id="firstHeading">{H}</h1><div id="bodyContent"><div id="mw-content-text"><p>{A}</p><h2>Background</h2><p>{B}</p><ul><li>{C}</li><li><a href="/tickets">Tickets</a> are sold on board and cost the same all year.</li></ul><p>{D}</p></div></div></div><div id="footer"><ul><li>This page was last changed in April.</li><li><a href="/p">Privacy policy</a></li></ul></div></body>',
        " ".join((H, A, "Background", B, C, "Tickets are sold on board and cost the same all year.", D))),
    "newspaper": (
        f'<body><div class="cookie-consent"><p>We use cookies to improve this site. <button>Accept</button></p></div><div class="top-bar">{NAV.format("t")}</div><section class="story"><h1 class="headline">{H}</h1><div class="story-body"><p>{A}</p><div class="ad-slot">Buy two lamps, get a third one for nothing.</div><p>{B}</p><p>{C}</p><aside class="related"><h4>Read also</h4><ul><li><a href="/b">The bridge that never was</a></li></ul></aside><p>{D}</p></div></section><section class="newsletter-signup"><h3>Subscribe</h3><form><p>Get our newsletter every morning.</p><input></form></section></body>', TEXT),
    "documentation": (f'<body><div class="docs-sidebar">{NAV.format("toc")}</div><main class="docs-main"><div class="theme-doc-markdown markdown"><h1>{H}</h1><p>{A}</p><pre><code>ferry --every 1h</code></pre><p>{B}</p><blockquote><p>{C}</p></blockquote><p>{D}</p></div></main><footer class="footer"><div>Built with care. © 2022</div></footer></body>', " ".join((H, A, "ferry --every 1h", B, C, D))),
    "table layout": (f'<body><table width=100%><tr><td colspan=2><h2>Island News</h2></td></tr><tr><td width=150 class="menu"><a href=/>Home</a><br><a href=/n>News</a><br><a href=/s>Sport</a></td><td><h1>{H}</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></td></tr></table></body>', TEXT),
    "misleading names": (f'<body><nav>{NAV.format("a")}</nav><article><h1>{H}</h1><div class="related-work"><p>{A}</p></div><section id="contact-points"><p>{B}</p></section><p>{C}</p><p>{D}</p></article><footer>© Island News</footer></body>', TEXT),
    "links in a list": (f'<body><nav>{NAV.format("a")}</nav><article><h1>{H}</h1><p>{A}</p><ul><li>{B}</li><li><a href="/boats">The boats and their names</a></li><li>{C}</li></ul><p>{D}</p></article></body>', " ".join((H, A, B, "The boats and their names", C, D))),
    "quotes outside values": (f"<body><article><h1 data-x='it's'>{H}</h1><p title=\"say \"hello\"\">{A}</p><p class=x\"y>{B}</p><p>{C}</p><p>{D}</p></article></body>", TEXT),
    "labels of others": (f'<body><div data-y="left" data-y="2"><article data-y="x"><h1>{H}</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></article></div></body>', TEXT),
    "forum": (f'<body><div id="nav">{NAV.format("f")}</div><div class="thread"><div class="post-content"><h1>{H}</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></div><div class="replies"><div class="reply"><p>Thank you for this, I hope that it lasts.</p></div></div></div></body>', TEXT),
    "only menus": (f'<body><nav>{NAV.format("a")}</nav><div class="ad">Buy two lamps, get a third one for nothing.</div><footer>© Island News. All rights reserved.</footer></body>', ""),
}
