"""Small pages with their labels, from which the potentials of the tree model are counted.

``y=1`` marks content, ``y=0`` a block inside content that is none; other blocks are labelled like their parent.
"""

_WORDS = ("The council met on Tuesday to discuss the new bridge, which has been planned for more than ten years and "
          "will connect both sides of the river. Several speakers asked for a longer review of the costs.")
_MORE = "Work is expected to begin in spring, and the first section should be open two years later, the office said in a statement on its plans."
_LONG = f"{_WORDS} {_MORE} {_WORDS}"
_SHORT = "It was a long evening."
_MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li><li><a href="/d">Contact</a></li></ul>'
_COMMENTS = (f'<h3>Comments</h3><div class="comment"><p>Anna wrote:</p><p>{_MORE}</p></div><div class="comment"><p>{_SHORT}</p></div>'
             f'<ol><li><div><p>{_MORE}</p></div></li><li><p>{_WORDS}</p></li></ol>')
_FORM = '<label>Name</label><input><p>Leave a reply. Your address will not be shown.</p>'
_COOKIE = "<p>We use cookies to improve our pages. By going on you accept them.</p>"
_FOOT = '<p>&copy; 2024 The Daily. All rights reserved.</p><ul><li><a href="/i">Imprint</a></li><li><a href="/p">Privacy</a></li></ul>'

PAGES = [
    f"<header><h1><a href='/'>The Daily</a></h1><p>News from the valley</p></header><nav>{_MENU}</nav><article y=1><h1>Bridge</h1><p>{_LONG}</p><p>{_MORE}</p>"
    f"<p>{_SHORT}</p></article><aside><h3>Related</h3>{_MENU}<p>{_MORE}</p></aside><footer>{_FOOT}</footer>",
    f"<div id='header'><p>The Daily</p></div><div class='menu'>{_MENU}</div><div class='content' y=1><h2>Bridge</h2><p>{_LONG}</p><ul><li>one bridge</li><li>two lanes</li></ul>"
    f"<p>{_SHORT}</p></div><div class='sidebar'><h3>Popular</h3>{_MENU}<div><p>{_WORDS}</p></div></div><div id='footer'>{_FOOT}</div>",
    f"<div class='cookie-banner'>{_COOKIE}<p>{_MORE}</p></div><main y=1><article y=1><h1>Bridge</h1><p>{_WORDS}</p><div class='ad' y=0><p>Buy two, get one free.</p><p>{_MORE}</p></div>"
    f"<p>{_LONG}</p><p>{_SHORT}</p></article><section class='comments' y=0>{_COMMENTS}</section><form y=0>{_FORM}</form></main><footer>{_FOOT}</footer>",
    f"<nav>{_MENU}</nav><article y=1><header y=1><h1>Bridge</h1><p>{_SHORT}</p></header><div><p>{_WORDS}</p></div><section><h2>Plans</h2><p>{_MORE}</p><p>{_LONG}</p></section>"
    f"<div class='share' y=0><a href='/t'>Share</a> <a href='/f'>Send</a></div><div id='comments' y=0>{_COMMENTS}</div><footer y=0><p>Filed under news</p></footer></article>"
    f"<aside><p>{_WORDS}</p></aside><footer>{_FOOT}</footer>",
    f"<div><div>{_MENU}</div><div y=1><h1>Bridge</h1><p>{_LONG}</p><p>{_WORDS}</p><p>{_SHORT}</p><blockquote>{_MORE}</blockquote></div></div><div class='newsletter'><p>{_MORE}</p>{_FORM}</div>"
    f"<div class='footer'>{_FOOT}</div>",
    f"<h1 y=1>Bridge</h1><p y=1>{_LONG}</p><p y=1>{_MORE}</p><p y=1>{_WORDS}</p><div class='related'>{_MENU}</div>",
    f"<header><nav>{_MENU}</nav></header><div class='post' y=1><h1>Bridge</h1><div class='entry' y=1><p>{_WORDS}</p><table><tr><td>Length</td><td>200 m</td></tr><tr><td>Lanes</td><td>4</td></tr></table>"
    f"<pre>{_WORDS}</pre><figure><figcaption>The river in May.</figcaption></figure></div></div><div class='comments'>{_COMMENTS}<form>{_FORM}</form></div><div class='ads'><p>{_WORDS}</p></div>",
    f"<div class='notice'><p>{_MORE}</p></div><div role='navigation'>{_MENU}</div><div role='main' y=1><p>{_LONG}</p><ol><li><p>{_WORDS}</p></li><li>{_SHORT}</li></ol><h3>Plans</h3><p>{_MORE}</p></div>"
    f"<div role='complementary'><div><p>{_WORDS}</p></div></div><form><p>{_MORE}</p></form>",
    f"<article y=1><h1>Bridge</h1><nav class='toc' y=0>{_MENU}</nav><p>{_WORDS}</p><aside y=0><p>{_WORDS}</p><p>{_MORE}</p></aside><div class='notice' y=0><p>{_WORDS}</p></div><p>{_LONG}</p>"
    f"<div class='advert' y=0>{_MORE}</div><form y=0><p>{_MORE}</p>{_FORM}</form><div class='newsletter' y=0><p>{_WORDS}</p></div><p>{_MORE}</p><section class='related' y=0><h3>More</h3>{_MENU}</section>"
    f"<section id='comments' y=0><h2>Comments</h2><article class='comment' y=0><p>{_WORDS}</p><p>{_LONG}</p></article><article class='comment' y=0><p>{_SHORT}</p></article></section><footer y=0>{_FOOT}</footer></article>",
    f"<main y=1><aside y=0>{_MENU}<p>{_WORDS}</p></aside><div><h1>Bridge</h1><p>{_SHORT}</p><p>{_WORDS}</p><ul><li>{_SHORT}</li><li>{_WORDS}</li></ul></div><footer y=0><p>{_MORE}</p></footer></main>",
]
