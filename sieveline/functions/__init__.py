"""Quality measures and density, network and ranking kernels."""
