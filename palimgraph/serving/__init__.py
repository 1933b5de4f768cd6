"""What stands between a store and its clients."""
