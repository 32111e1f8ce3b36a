"""Interfaces that are refused on purpose: nothing stands in silently for a model that isn't here."""

from __future__ import annotations

from typing import NoReturn


def refuse(module: str) -> NoReturn:
    raise NotImplementedError(f"{module} is not implemented")


def fit_gamm(*_args, **_options) -> NoReturn:
    refuse("the additive mixed model with autocorrelated residuals")


def fit_sparse_components(*_args, **_options) -> NoReturn:
    refuse("conditional-expectation components of sparse curves")


def fit_autocorrelated_spline(*_args, **_options) -> NoReturn:
    refuse("the mixed spline with autocorrelated residuals")


def read_acquisition(*_args, **_options) -> NoReturn:
    refuse("the reader of vendor acquisition files")


def read_hdf5(*_args, **_options) -> NoReturn:
    refuse("the reader of HDF5 files")


def fit_markov(*_args, **_options) -> NoReturn:
    refuse("the transition regression")
