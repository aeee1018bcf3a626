"""A self-contained HTML page of tabs from figures that can render themselves."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence


def render(title: str, tabs: Mapping[str, Sequence[tuple[str, str, object]]], notes: Sequence[str] = ()) -> str:
    """``tabs``: tab name → (unique id, heading, figure).

    A figure has ``to_html(full_html, include_plotlyjs)`` or is already HTML.
    The plotting script is included once, by the first figure.  An id used
    twice, or a page without a tab, raises ValueError.
    """
    if not tabs:
        raise ValueError("a dashboard has one tab at least")
    seen: set[str] = set()
    buttons, panels, script = [], [], True
    for k, (name, visuals) in enumerate(tabs.items()):
        cards = []
        for ident, heading, figure in visuals:
            if ident in seen:
                raise ValueError(f"visual id used twice: {ident}")
            seen.add(ident)
            if hasattr(figure, "to_html"):
                body = figure.to_html(full_html=False, include_plotlyjs="cdn" if script else False)
                script = False
            else:
                body = str(figure)
            cards.append(f'<section class="card" id="{html.escape(ident, True)}"><h3>{html.escape(heading)}</h3>{body}</section>')
        on = " active" if k == 0 else ""
        buttons.append(f'<button class="tab{on}" data-panel="panel-{k}">{html.escape(name)}</button>')
        panels.append(f'<div class="panel{on}" id="panel-{k}">{"".join(cards)}</div>')
    style = "body{font-family:sans-serif;margin:2em}.panel{display:none}.panel.active{display:block}.tab.active{font-weight:bold}"
    code = ("document.querySelectorAll('.tab').forEach(b=>b.onclick=()=>{document.querySelectorAll('.tab,.panel')"
            ".forEach(x=>x.classList.remove('active'));b.classList.add('active');"
            "document.getElementById(b.dataset.panel).classList.add('active')})")
    foot = "".join(f"<p>{html.escape(n)}</p>" for n in notes)
    return (f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head>"
            f"<body><h1>{html.escape(title)}</h1><nav>{''.join(buttons)}</nav>{''.join(panels)}{foot}<script>{code}</script></body></html>")
