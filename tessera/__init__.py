"""Feature tables on Spark: datasets with meaningful schemas, and graphs of column operators compiled to one plan."""

from importlib import import_module

#: Names and the modules that have them, which are imported when first asked for, so that workers stay small.
_WHERE = {
    "operators.base": ["Operator", "StatOperator"],
    "operators.columns": ["UDF", "AddMetadata", "AddProperties", "AddTags", "ConcatColumns", "GroupingOp", "Rename", "SelectionOp", "Subgraph", "SubsetColumns", "SubtractionOp", "TagAsItemFeatures", "TagAsItemID", "TagAsUserFeatures", "TagAsUserID"],
    "operators.states": ["Cube", "Standardize"],
    "operators.stats": ["Aggregate", "FrequencyEncode", "MinMaxScale", "ShiftToZero"],
    "plans.dtypes": ["DType", "dtype"],
    "plans.graph": ["Executor", "Graph", "Runtime"],
    "plans.node": ["Node"],
    "plans.schema": ["ColumnSchema", "Domain", "Schema"],
    "plans.selector": ["ColumnSelector"],
    "plans.shapes": ["Dimension", "Shape"],
    "plans.tags": ["Tags", "TagSet"],
    "sources.dataset": ["Dataset"],
    "sources.sinks": ["Shuffle"],
    "functions.table": ["TensorColumn", "TensorTable"],
}
__all__ = sorted(n for names in _WHERE.values() for n in names)


def __getattr__(name: str):
    for module, names in _WHERE.items():
        if name in names:
            return getattr(import_module(f".{module}", __name__), name)
    raise AttributeError(name)
