"""Model clients that need no library: a command that is given the prompt and writes the reply."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

from leafmill.operators.extract import Completion


def command_client(command: list[str], timeout: float = 150.0, model: str | None = None, stdin: bool = False) -> Callable[[str], Completion]:
    """A client that starts ``command`` for each prompt, its last argument, or its input with ``stdin``; the reply is its output. Costs are not metered.

    A command that cannot be started, fails, or takes more than ``timeout`` seconds has an empty reply, which becomes an error row.
    """

    def ask(prompt: str) -> Completion:
        try:
            done = subprocess.run(command if stdin else [*command, prompt], input=prompt if stdin else "", capture_output=True, text=True, encoding="utf-8", timeout=timeout, check=False)
        except (OSError, subprocess.TimeoutExpired, UnicodeError):
            return Completion("", model=model)
        return Completion("" if done.returncode else done.stdout.strip(), model=model)

    return ask


def engines_of(config: dict | None) -> dict[str, Callable[[str], Completion]]:
    """Clients from a pipeline file's ``engines``: {name: {command: [...], timeout: seconds, model: name, stdin: bool}}."""
    if not config:
        return {}
    if not isinstance(config, dict):
        raise ValueError("engines is a mapping of names")
    out = {}
    for name, how in config.items():
        if not isinstance(how, dict) or not isinstance(how.get("command"), list) or not how["command"] or set(how) - {"command", "timeout", "model", "stdin"}:
            raise ValueError(f"engine {name!r} is a mapping with a list 'command', and perhaps 'timeout', 'model' and 'stdin'")
        out[name] = command_client([str(x) for x in how["command"]], float(how.get("timeout", 150)), how.get("model"), bool(how.get("stdin")))
    return out
