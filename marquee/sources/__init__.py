"""Inputs and outputs: theatres, captured pages, rating candidates, archive, exports."""
