"""The library's operators: functions from DataFrames to DataFrames, registered under query names."""

import importlib
import pkgutil


def load() -> None:
    """Imports every module that registers queries."""
    import ferrule.sources
    import ferrule.streaming

    for package in (importlib.import_module(__name__), ferrule.sources, ferrule.streaming):
        for m in pkgutil.iter_modules(package.__path__, package.__name__ + "."):
            importlib.import_module(m.name)
