"""A small workspace whose facts are known: the example of the registered queries and the tests."""

from __future__ import annotations

import json
from pathlib import Path

#: An observatory: a go.work with two modules, a third one that only the walk finds, a required
#: module that is nowhere, a replacement that points to no module, a file that does not parse, two
#: modules that import each other, methods, loops, switches and selects.
FILES = {
    "go.work": "go 1.22\n\nuse (\n\t./night\n\t./lens\n)\n",
    "night/go.mod": "module obs.test/night\n\nrequire far.test/clock v1.4.0 // not on this disk\nrequire obs.test/lens v0.2.0\n",
    "night/watch.go": 'package night\n\nimport (\n\t"fmt"\n\n\t"obs.test/lens/glass"\n\t"obs.test/night/dome"\n)\n\nfunc Watch(hours int) {\n\td := dome.New("west")\n\tfor h := 0; h < hours; h++ {\n\t\tfmt.Println(d.Open(h), glass.Focus(h))\n\t}\n}\n',
    "night/dome/dome.go": "package dome\n\ntype Shutter interface {\n\tOpen(hour int) bool\n}\n\ntype Dome struct {\n\tSide    string\n\tAzimuth int\n}\n\nfunc New(side string) *Dome { return &Dome{Side: side} }\n\nfunc (d *Dome) Open(hour int) bool {\n\tswitch {\n\tcase hour < 5 || hour > 20:\n\t\treturn true\n\tdefault:\n\t\treturn d.Azimuth == 0\n\t}\n}\n",
    "night/dome/torn.go": "package dome\n\nfunc Half( {\n",
    "night/order/service.go": "package order\n\nfunc Queue(stars chan string, done chan bool) {\n\tdefer close(done)\n\tselect {\n\tcase s := <-stars:\n\t\tprintln(s)\n\tcase <-done:\n\t}\n}\n",
    "lens/go.mod": "module obs.test/lens\n\nreplace obs.test/mount => ../mount\n",
    "lens/glass/glass.go": 'package glass\n\nimport (\n\t"far.test/clock/tick"\n\t"obs.test/night/dome"\n)\n\nfunc Focus(n int) int {\n\ttick.Wait()\n\tif dome.New("east") != nil && n%2 == 0 {\n\t\treturn n\n\t}\n\treturn 0\n}\n',
    "spare/go.mod": "module obs.test/spare\n",
    "spare/box.go": "package spare\n\ntype Box []string\n",
    ".cache/skip.go": "package skip\n",
}
CONFIG = {
    "complexity": {"cyclomatic": {"warningThreshold": 3}},
    "packageImportPolicy": {"rules": [{"id": "glass_alone", "package": "obs.test/lens/glass", "deny": ["obs.test/night/dome"]}, {"package": "obs.test/night", "allow": ["fmt", "obs.test/night/dome", "obs.test/lens/glass"]}]},
    "ubiquitousLanguage": {"contexts": [{"id": "sky", "packagePrefixes": ["obs.test/night", "obs.test/lens"], "terms": ["dome", "watch", "glass"], "discouragedTerms": ["azimuth"]}], "ignoredTerms": ["obs", "test"]},
}


def lay(top: Path) -> Path:
    """Write the workspace below ``top``; its entry is ``top / "night"``."""
    for path, text in FILES.items():
        f = top / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (top / "night" / "factloom.config.json").write_text(json.dumps(CONFIG))
    return top
