"""A small labelled table for the block classifier: hand-written pages, each block marked + (article) or - (the rest).

A page is (html, marks): one mark for each of its blocks, in order.
"""

LONG = "The committee met on Tuesday to discuss the new harbour plan, and after two hours of debate most members agreed that the old pier should stay open until the end of the year."
LONG2 = "Researchers who followed the river for three summers found that its banks had moved by almost a metre, mainly where the willows had been cut and the cattle went down to drink."
LONG3 = "When the last ferry of the season left, the innkeeper closed the shutters, wrote the number of guests into her book, and found that it had been the best year since the bridge was built."
MID = "Local shops reported higher sales in the spring than a year before."
MID2 = "Nobody had expected that the vote would be so close."
MID3 = "The museum will open its doors again on the first of May."
SHORT, SHORT2, SHORT3 = "It rained.", "Rain fell all day.", "So it was."


def links(*names):
    return "".join(f"<li><a href=/{n}>{n}</a></li>" for n in names)


def divs(*names):
    return "".join(f"<div><a href=/{n}>{n}</a></div>" for n in names)


def paras(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


MENU = f"<nav><ul>{links('Home', 'News', 'Sport')}</ul></nav>"
FOOT = "<footer>&copy; Harbour Daily</footer>"

PAGES = [
    # the article is marked
    (f"{MENU}<article><h1>Harbour plan</h1>{paras(LONG, SHORT, MID)}</article>{FOOT}", "---++++-"),
    (f"{MENU}<article><h1>Storm</h1>{paras(LONG, SHORT)}</article>", "---+++"),
    (f"<article>{paras(SHORT2)}</article>", "+"),
    (f"<article><h1>Only a title</h1></article>{FOOT}", "+-"),
    (f"{MENU}<article><h1>Storm</h1></article><aside><h3>Most read</h3>{paras(MID)}</aside>", "---+--"),
    (f"<header><a href=/>Daily</a><p>News since 1901</p></header><div class=ad>{MID}</div><main><h1>Prices</h1>{paras(MID + ' ' + MID2)}<p><a href=/x>{MID}</a></p><p>Why.</p></main><aside><h3>Most read</h3><p>{MID}</p></aside>", "---++++--"),
    (f"<div class='menu'><a href=/1>One</a> <a href=/2>Two</a></div><div class='content'><h2>Title here</h2>{paras(LONG2, LONG)}</div><div class='comments'>{paras(MID, SHORT)}</div><div id='footer'>Imprint</div>", "-+++---"),
    (f"<article><header><h1>Storm</h1></header>{paras(LONG)}<form><label>Your mail</label>{paras('Sign up for our letter today.')}</form>{paras(MID)}<div class='advert'>{LONG3}</div>{paras(SHORT3)}</article><footer>{paras(LONG2)}</footer>", "++--+-+-"),
    (f"<div class='cookie-notice'>{paras('We use cookies on this site to measure how it is used and to remember what you like.')}</div><article>{paras(SHORT, SHORT3)}<ul><li>{MID}</li><li>Ships</li></ul></article><section id=comments>{paras(LONG3)}</section>", "-++++-"),
    (f"<div class='sidebar'>{paras(LONG)}</div><div class='post'>{paras(LONG2, SHORT)}</div><div class='banner'>{MID}</div>", "-++-"),
    (f"<article>{paras(LONG)}<ul>{links('First ship', 'Second ship')}</ul>{paras('Copyright was not at issue.', SHORT)}</article>", "+++++"),
    (f"<main><h1>Words</h1>{paras(SHORT, 'Cookies are eaten here.', MID3)}<h2>More</h2>{paras(SHORT2)}</main><div class=related><h3>Related</h3><ul>{links('Boats', 'Piers')}</ul></div>", "++++++---"),
    (f"{divs('World', 'Money')}<article><h1>Ferry</h1>{paras(LONG3)}</article>{paras(MID)}{divs('More')}", "--++--"),
    (f"<p>{MID2}</p><article>{paras(SHORT, SHORT2, SHORT3)}</article><p>{SHORT}</p>", "-+++-"),
    (f"<article>{paras(LONG, MID)}<p><a href=/x>{MID2}</a></p>{paras(SHORT)}<p><a href=/y>Read the report</a></p></article>{divs('All news of the day', 'Weather and tides')}", "+++++--"),
    (f"<article>{paras(LONG2, SHORT2)}</article>{divs('Back to the first page', 'Write to us')}<p>All rights reserved.</p>", "++---"),
    (f"<article>{paras(SHORT, LONG3)}</article>{paras(MID)}{divs('Write to us now')}", "++--"),
    (f"<article><h1>Tide</h1>{paras(LONG)}</article><div>{paras(LONG2, LONG3)}</div>{FOOT}", "++---"),
    (f"{divs('First page of the news')}<article><h2>Tide</h2><p><a href=/z>Tide table</a></p>{paras(SHORT3, MID3)}</article>{divs('Last page of the news')}", "-++++-"),
    (f"<div>{paras(MID, LONG)}</div><article>{paras(MID2, SHORT)}</article><div>{paras(LONG3)}</div>", "--++-"),
    (f"<article>{paras('3 replies', LONG, SHORT)}</article><h3>2 comments</h3><div>{paras(MID, SHORT2)}</div>", "+++---"),
    # nothing is marked
    (f"{divs('Start', 'Sport')}<div>{paras(LONG, LONG2, SHORT, LONG3)}</div><div><a href=/i>Imprint</a> <a href=/c>Contact</a></div>", "--++++-"),
    (f"<h1>The ferry</h1>{paras(LONG3, LONG, MID, 'All rights reserved.')}", "++++-"),
    (f"<p>{LONG}</p><p>{LONG2}</p><p>{LONG3}</p>", "+++"),
    (f"{divs('World', 'Money', 'Weather')}{paras(MID, LONG, LONG2)}{divs('More', 'Login')}", "---+++--"),
    (f"<p>{SHORT2}</p>", "+"),
    (f"<h1>Note</h1><p>{MID3}</p>", "++"),
    (f"{paras(MID, SHORT, MID2)}", "+++"),
    (f"<h1>List</h1><ul><li>{SHORT}</li><li>{SHORT2}</li><li>Ships</li></ul>{paras(LONG2)}", "+++++"),
    (f"<div>{paras(LONG3, MID2)}</div><h3>3 replies</h3><div>{paras(MID, LONG)}</div>", "++---"),
    (f"{paras(LONG2, SHORT)}<h4>Comments (12)</h4>{paras(SHORT2, MID3, LONG)}", "++----"),
    (f"<ul>{links('Home', 'News')}</ul><h1>Quay</h1>{paras(SHORT3, LONG)}<ul>{links('Older', 'Newer')}</ul><div>&copy; 1998 Quay Press</div>", "--+++---"),
    (f"<div>{paras(LONG, 'Log in to vote.', LONG2)}</div><div>Subscribe to our letter.</div>", "+-+-"),
    (f"<div>Home</div><div>News</div><div>Tide tables</div><h1>Ferry</h1>{paras(LONG3, SHORT, LONG)}<div>Imprint</div><div>Contact</div>", "---++++--"),
    (f"<div>Menu</div><div>Sport</div><div>Money</div>{paras(LONG2, MID)}<div>Top</div><div>Print</div><div>Login</div>", "---++---"),
    (f"<div><a href=/w>World</a></div><div>Evening edition</div><div><a href=/m>Money</a></div><h1>Quay</h1>{paras(MID, LONG)}<div><a href=/o>Older</a></div><div>Page two</div><div><a href=/n>Newer</a></div>", "---+++---"),
    (f"<h1>Tides</h1>{paras(LONG, SHORT2, SHORT, SHORT3, LONG2)}", "++++++"),
    *((f"<p>{t}</p>", "+") for t in ("Gone", "It rained.", "Rain fell today.", "Rain fell all day long.")),
    ("<h1>Note</h1><p>Gone fishing.</p>", "++"),
    # wrappers with misleading names
    (f"<div class='search-page'>{MENU}<article><h1>Pier</h1>{paras(LONG, SHORT3)}</article></div>", "---+++"),
    (f"<div class='page legal'><h1>Pier</h1>{paras(LONG2, MID)}</div>", "+++"),
    (f"<form>{MENU}<div>{paras(LONG, LONG3, SHORT)}</div></form>", "---+++"),
]
