"""Plans made of several operators: models, training, and the stack language."""
