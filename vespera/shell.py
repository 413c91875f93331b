"""An interactive shell over one engine: create, open, close, drop, upsert, ups2, del, knn, get, load, gen, macc, mdelta, print, stats."""

from __future__ import annotations

import cmd
import json
import shlex

from vespera.plans.engine import Engine
from vespera.types import EngineError


class Shell(cmd.Cmd):
    prompt = "vespera> "

    def __init__(self, engine: Engine, **more):
        super().__init__(**more)
        self.engine = engine

    def onecmd(self, line: str) -> bool:
        words = shlex.split(line)
        if not words:
            return False
        if words[0] in ("quit", "exit", "EOF"):
            self.engine.disconnect()
            return True
        try:
            out = self.run(words[0], words[1:])
        except (EngineError, ValueError, IndexError) as e:
            out = f"error: {e}"
        if out is not None:
            print(out, file=self.stdout)
        return False

    def run(self, name: str, args: list[str]):
        e = self.engine
        if name == "create":
            e.create(args[0], **{k: int(v) if v.isdigit() else v for k, v in (a.split("=") for a in args[1:])})
        elif name in ("open", "close", "drop"):
            getattr(e, name)(args[0])
        elif name == "upsert":
            e.upsert(int(args[0]), " ".join(args[1:]))
        elif name == "ups2":
            e.ups2(int(args[0]), float(args[1]))
        elif name == "del":
            e.delete(int(args[0]))
        elif name == "knn":
            return e.knn(" ".join(args[1:]), int(args[0]))
        elif name == "get":
            return e.get(int(args[0]))
        elif name == "load":
            e.load_file(args[0])
        elif name == "gen":
            e.generate(*map(int, args))
        elif name == "macc":
            e.merge_accumulator()
        elif name == "mdelta":
            e.merge_delta()
        elif name == "print":
            e.print_rows()
        elif name == "stats":
            return json.dumps(e.stats(), indent=2)
        else:
            raise EngineError(f"unknown command: {name}")
        return None
