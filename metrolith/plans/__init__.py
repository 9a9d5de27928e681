"""The semantic model, the planner, frames and sessions."""
