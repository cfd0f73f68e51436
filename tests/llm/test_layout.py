"""What a page shows: style sheets, visibility, pictures, form fields, spans of cells."""

from __future__ import annotations

import pytest

from tallyloom.llm.rendering import visible_text


@pytest.mark.parametrize(
    "page, want",
    [
        ("<style>@media print{.x{display:none}} .y{display:none}</style><p class=x>on screen<p class=y>never", "on screen"),
        ("<style>@media screen, print{.x{display:none}}</style><p class=x>gone<p>kept", "kept"),
        ("<style>@media (max-width:9px){p{display:none}} @font-face{x:y} @supports (a:b){.s{display:none}}</style><p>kept<b class=s>gone</b>", "kept"),
        ("<style>div.x{display:none} ul > li.z{display:none} nav a{visibility:hidden}</style><div class='x w'>a</div><p class=x>b</p><ul><li class=z>c<li>d</ul><nav><b><a>e</a></b>f</nav>", "b\n\n- d\n\nf"),
        ("<style>p{display:none} p.on{display:block}</style><p>off<p class=on>on", "on"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b></div>", "yes"),
        ("<div style='display:none'>no<b style='visibility:visible'>no</b></div>x", "x"),
        ("a <svg><title>t</title><desc>d</desc><text>drawn</text></svg> <math><mi>y</mi><annotation>tex</annotation></math>", "a drawn y"),
        ("<input value=typed> <input type=password value=secret> <input type=submit value=Go>", "typed Go"),
        ("<select><option>o1<option>o2</select>after", "o1\no2\nafter"),
        ("<table><tr><td>a<td>bb<td>c<tr><td colspan=2>wide<td>z</table>", "a  bb  c\nwide   z"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td colspan=2>a very wide one<td>x<tr><td>1<td>2<td>3</table>", "a very wide one  x\n1  2             3"),
        ("<style>a{}b{color:red}}}.q{display:none}</style><p class=q>no<p>yes", "yes"),
        ("<style>.q{display:none", ""),
    ],
)
def test_shown(page, want):
    assert visible_text(page) == want
