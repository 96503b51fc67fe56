"""An audit as one HTML page: funnel, sliders for the knobs, and the slide's patches coloured by what dropped them."""

from __future__ import annotations

import html
import json

from pyspark.sql import functions as F

from slidemill.operators import audit
from slidemill.plans.builder import Audit

#: Patches of one slide that a page holds; a slide of more is drawn by an even sample of its rows, and says so.
SHOWN = 50_000

PAGE = """<!doctype html><meta charset="utf-8"><title>%(title)s</title>
<style>body{font:14px sans-serif;margin:1em}canvas{border:1px solid #999}td,th{padding:2px 8px;text-align:right}</style>
<h1>%(title)s</h1><p>%(note)s</p><pre>%(exact)s</pre><div id="knobs"></div><table id="funnel"></table><canvas id="map" width="800" height="600"></canvas>
<script>
const data = %(data)s, colours = ["#c33", "#e90", "#36c", "#939", "#699"];
const hits = (k, v, row) => { const m = row[k.column]; if (m == null) return false;
  return !(k.op === ">=" ? m >= v : k.op === "<=" ? m <= v : k.op === ">" ? m > v : m < v); };
let order = data.knobs.map((k, i) => i);
function draw() {
  const values = data.knobs.map((k, i) => +document.getElementById("k" + i).value), lost = data.knobs.map(() => 0);
  const on = order.filter(i => document.getElementById("on" + i).checked);
  const c = document.getElementById("map").getContext("2d"), s = Math.min(800 / data.w, 600 / data.h);
  c.clearRect(0, 0, 800, 600);
  for (const row of data.rows) {
    const by = on.find(i => hits(data.knobs[i], values[i], row)) ?? -1;
    if (by >= 0) lost[by]++;
    c.fillStyle = by < 0 ? "#3a3" : colours[by %% colours.length];
    c.fillRect(row.x * s, row.y * s, data.tile * s - 0.5, data.tile * s - 0.5);
  }
  let left = data.rows.length, out = "<tr><th>stage<th>in<th>out<th>dropped";
  on.forEach(i => { out += `<tr><td>${data.knobs[i].stage}<td>${left}<td>${left - lost[i]}<td>${lost[i]}`; left -= lost[i]; });
  document.getElementById("funnel").innerHTML = out;
}
function earlier(i) {
  const at = order.indexOf(i);
  if (at > 0 && data.knobs[i].segment === data.knobs[order[at - 1]].segment) { [order[at - 1], order[at]] = [i, order[at - 1]]; place(); draw(); }
}
function place() { order.forEach(i => document.getElementById("knobs").append(document.getElementById("row" + i))); }
data.knobs.forEach((k, i) => { document.getElementById("knobs").insertAdjacentHTML("beforeend",
  `<div id="row${i}"><input type="checkbox" id="on${i}" checked onchange="draw()"><button onclick="earlier(${i})">earlier</button> <label>${k.stage} ${k.column} ${k.op} <input type="range" id="k${i}" min="${k.low}" max="${k.high}" step="${k.step}" value="${k.value}" oninput="draw()"></label></div>`); });
draw();
</script>"""


class Report:
    def __init__(self, text: str):
        self.text = text

    def _repr_html_(self) -> str:
        return f'<iframe width="100%" height="900" srcdoc="{html.escape(self.text, quote=True)}"></iframe>'

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.text)


def visualize(found: Audit, wsi_id: str, tile_size: int) -> Report:
    """The report of one slide: what its run kept, exactly, and sliders, switches and places for the knobs; KeyError if it was not audited. Filters change places with their neighbours, not across a transform."""
    own = found.rows.filter(F.col("wsi_id") == wsi_id)
    n, w, h = own.agg(F.count("*"), F.max("sw"), F.max("sh")).first()
    if not n:
        raise KeyError(wsi_id)
    metrics = [k.column for k in found.knobs]
    rows = [r.asDict() for r in own.select("x", "y", *metrics).orderBy(F.xxhash64("x", "y")).limit(SHOWN).collect()]
    named = audit.labelled(found.knobs)
    counted = audit.text_table(audit.funnel(own, named).collect())
    knobs = []
    for place, k in enumerate(named):
        low, high, step = audit.slider_range(own, k)
        knobs.append({"stage": k.stage, "column": k.column, "op": k.op, "value": k.value, "low": low, "high": high, "step": step, "segment": found.segments[place] if found.segments else 0})
    note = f"{n} patches" + (f"; {SHOWN} of them, evenly sampled, are drawn and counted below the sliders, the first table counts all" if n > SHOWN else "")
    data = json.dumps({"rows": rows, "knobs": knobs, "w": w, "h": h, "tile": tile_size}).replace("</", "<\\/")
    return Report(PAGE % {"title": html.escape(wsi_id), "note": note, "exact": html.escape(counted), "data": data})
