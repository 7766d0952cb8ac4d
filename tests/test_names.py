"""Every global name that the plans' functions use is there, also where no query of the small tables runs them."""

import builtins
import dis
import importlib
import pkgutil
from types import CodeType

import pytest

from foliant import plans

MODULES = sorted(m.name for m in pkgutil.iter_modules(plans.__path__))


def used(code: CodeType) -> set[str]:
    names = {i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL"}
    return names.union(*(used(c) for c in code.co_consts if isinstance(c, CodeType)))


@pytest.mark.parametrize("name", MODULES)
def test_global_names_are_defined(name):
    module = importlib.import_module(f"foliant.plans.{name}")
    with open(module.__file__) as f:
        missing = used(compile(f.read(), module.__file__, "exec")) - set(vars(module)) - set(vars(builtins))
    assert missing == set()
