"""Readers, writers and views of shot gathers, acquisition geometry and earth-model grids."""
