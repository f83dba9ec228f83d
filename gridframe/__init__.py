"""Dense n-dimensional arrays as Spark DataFrames keyed by their indices.

Names are loaded on first use, so that Spark's workers import only what they run.
"""

from importlib import import_module

_HOME = {
    "functions.units": "NAMED Unit UnitError unit",
    "grid": "GridFrame elementwise",
    "operators.combine": "concatenate stack",
    "operators.copyplan": "Copy CopyPlan copy_boxes",
    "operators.halo": "BlockFrame HaloUpdate start_halo_update",
    "operators.numpy_api": "angle around clip imag real where",
    "operators.placement": "block_numbering deposit deposit_cloud migrate owner_column placed rebalance redistribute",
    "operators.reduce": "allclose allreduce_replicated array_equal isclose",
    "operators.stencil": "StencilOperator",
    "operators.tiles": "TileFrame tiled_layout",
    "plans.layout": "GridLayout chunk_bounds process_grid weighted_cuts",
    "profiling": "Profile",
    "sources.create": "arange array asarray empty empty_like from_local from_sums from_table fromfunction fromfunction_numpy full full_like linspace ones ones_like reshaped zeros zeros_like",
    "sources.hdf5": "load_hdf5 save_hdf5",
    "sources.npy": "load save",
    "streaming.deposit": "deposit_stream",
}
_MODULE = {name: module for module, names in _HOME.items() for name in names.split()}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(f"module 'gridframe' has no attribute {name!r}")
    return getattr(import_module(f"gridframe.{_MODULE[name]}"), name)
