"""Dataflow operators: frames in, frames out, nothing collected."""
