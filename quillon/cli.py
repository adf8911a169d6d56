"""A shell: statements end with ``;``. ``\\load csv NAME PATH``, ``\\dt``, ``\\explain QUERY``, ``\\q``."""

from __future__ import annotations

import shlex
import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from quillon.errors import EngineError, ParseError
from quillon.session import Engine


def command(engine: Engine, line: str) -> bool:
    """Run one command or script; False to leave."""
    words = line.strip().split(maxsplit=1)
    if not words:
        return True
    rest = words[1].rstrip("; \n") if len(words) > 1 else ""
    if words[0] in ("\\q", "exit", "quit"):
        return False
    if words[0] == "\\dt":
        engine.show_tables().show(truncate=False)
    elif words[0] == "\\explain":
        print(engine.explain(rest))
    elif words[0] == "\\load":
        parts = shlex.split(rest)
        if len(parts) != 3 or parts[0] != "csv":
            raise ParseError("\\load csv NAME PATH")
        engine.load_csv(parts[1], parts[2])
    else:
        for df in engine.run(line):
            if df.columns:
                df.show(truncate=False)
    return True


def main() -> None:
    engine, text = Engine(SparkSession.builder.appName("quillon").getOrCreate()), ""
    while True:
        try:
            text += input("quillon> " if not text else "      -> ") + "\n"
            if not text.startswith("\\") and text.strip() not in ("", "exit", "quit") and not text.rstrip().endswith(";"):
                continue
            began, line, text = time.time(), text, ""
            if not command(engine, line):
                return
            print(f"{time.time() - began:.2f} s")
        except EOFError:
            return
        except (EngineError, PySparkException) as e:
            print(f"error: {e}")


if __name__ == "__main__":
    main()
