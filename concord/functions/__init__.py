"""Column functions: vectors, top-k means, probabilities, labels and step arithmetic."""
