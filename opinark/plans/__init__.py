"""Named queries of the core operators."""

import importlib

MODULES = ("packed", "cleaning", "profiling", "labelling", "more", "files", "rules", "models")


def load():
    from opinark.plans.registry import core

    for name in MODULES:
        importlib.import_module(f"opinark.plans.{name}")
    return core
