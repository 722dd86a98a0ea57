"""So that the tests find `cases` whatever the folder pytest starts in."""

import importlib.util
import pathlib

_spec = importlib.util.spec_from_file_location("llm_cases", pathlib.Path(__file__).parent / "cases.py")
cases = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(cases)
