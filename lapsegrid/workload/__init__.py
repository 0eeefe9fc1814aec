"""Every operator applied to the shared tables, with its answer in plain SQL."""

import importlib
import pkgutil

from lapsegrid.workload import registry

for _module in pkgutil.iter_modules(__path__):
    if _module.name != "registry":
        importlib.import_module(f"{__name__}.{_module.name}")

callables, sql_texts = registry.callables, registry.sql_texts
