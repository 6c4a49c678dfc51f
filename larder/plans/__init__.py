"""Business plans composed of the operators."""
