"""Layers against finite differences, and small known values."""

from __future__ import annotations

import numpy as np
import pytest

from quillmill import nn
from quillmill.errors import InvalidInput, InvalidParameter

R = np.random.default_rng(0)
CASES = [
    (nn.Dense(4, 3, "tanh", random_state=1), (5, 4)),
    (nn.Dense(4, 3, "softmax", random_state=1), (5, 4)),
    (nn.PReLU((4,)), (5, 4)),
    (nn.Conv1D(3, 2, (6, 2), 2, "sigmoid", "same", 1), (2, 6, 2)),
    (nn.Conv2D(3, (2, 3), (5, 6, 2), (2, 1), "tanh", "valid", 1), (2, 5, 6, 2)),
    (nn.Conv3D(2, 2, (3, 3, 3, 1), 1, None, "same", 1), (2, 3, 3, 3, 1)),
    (nn.Conv1DTranspose(3, 3, (4, 2), 2, None, "valid", 1), (2, 4, 2)),
    (nn.Conv2DTranspose(2, 3, (3, 3, 2), 2, "tanh", "same", 1), (2, 3, 3, 2)),
    (nn.Conv3DTranspose(1, 2, (2, 2, 2, 1), 1, None, "valid", 1), (1, 2, 2, 2, 1)),
    (nn.DepthwiseConv1D(2, (5, 2), 1, None, "same", 2, 1), (2, 5, 2)),
    (nn.DepthwiseConv2D(2, (4, 4, 2), 2, "tanh", "valid", 2, 1), (2, 4, 4, 2)),
    (nn.SeparableConv1D(3, 2, (5, 2), 1, 2, None, "same", 1), (2, 5, 2)),
    (nn.SeparableConv2D(3, 2, (4, 4, 2), 1, 1, "tanh", "valid", 1), (2, 4, 4, 2)),
    (nn.MaxPooling1D(2), (2, 6, 2)),
    (nn.MaxPooling2D(2, strides=1, padding="same"), (2, 4, 4, 2)),
    (nn.MaxPooling3D(2), (1, 4, 4, 4, 1)),
    (nn.AveragePooling1D(3, strides=2, padding="same"), (2, 6, 2)),
    (nn.AveragePooling2D(2), (2, 4, 4, 2)),
    (nn.AveragePooling3D(2), (1, 4, 4, 4, 1)),
    (nn.GlobalMaxPooling2D(), (2, 3, 3, 2)),
    (nn.GlobalAveragePooling3D(), (2, 2, 2, 2, 2)),
    (nn.ZeroPadding2D(((1, 2), (0, 1))), (2, 3, 3, 2)),
    (nn.Cropping2D(((1, 0), (1, 1))), (2, 4, 4, 2)),
    (nn.UpSampling1D(2), (2, 3, 2)),
    (nn.UpSampling2D(2, "bilinear"), (2, 3, 3, 2)),
    (nn.UpSampling2D((2, 3), "bicubic"), (1, 4, 4, 1)),
    (nn.UpSampling2D(2, "lanczos3"), (1, 4, 4, 1)),
    (nn.UpSampling3D(2), (1, 2, 2, 2, 1)),
    (nn.SimpleRNN(2, 3, "tanh", 1), (2, 4, 2)),
    (nn.LSTM(2, 3, "tanh", 1), (2, 4, 2)),
    (nn.GRU(2, 3, "tanh", 1), (2, 4, 2)),
    (nn.BatchNormalization((3, 2)), (4, 3, 2)),
    (nn.LayerNormalization((3, 4)), (2, 3, 4)),
    (nn.LayerNormalization((3, 4), axis=(1, 2)), (2, 3, 4)),
    (nn.GroupNormalization((3, 4), 2), (2, 3, 4)),
    (nn.InstanceNormalization((3, 4)), (2, 3, 4)),
    (nn.UnitNormalization(), (2, 3, 4)),
    (nn.Permute((2, 1)), (2, 3, 4)),
    (nn.RepeatVector(3), (2, 4)),
    (nn.Flatten(), (2, 3, 4)),
    (nn.Reshape((-1, 2)), (2, 3, 4)),
    *[(nn.ActivationLayer(a), (3, 4)) for a in ("relu", "sigmoid", "tanh", "softmax", "selu", "softplus", "softsign", "hard_sigmoid", "exponential", "leaky_relu", "elu")],
]


@pytest.mark.parametrize("layer, shape", CASES, ids=lambda v: type(v).__name__ if not isinstance(v, tuple) else "x".join(map(str, v)))
def test_gradients(layer, shape):
    x = R.normal(size=shape).astype(np.float32)
    y = layer.forward(x, True)
    w = R.normal(size=y.shape).astype(np.float32)
    dx = layer.backward(w)
    assert dx.shape == x.shape
    total = lambda: float((layer.forward(x, True).astype(np.float64) * w).sum())

    def slope(a: np.ndarray, at: tuple) -> float:
        old, h = a[at], np.float32(1e-2)
        a[at] = old + h
        up = total()
        a[at] = old - h
        down = total()
        a[at] = old
        return (up - down) / (2 * float(h))

    grads = {k: v.copy() for k, v in layer.grads.items()}
    for a, g in [(x, dx), *((layer.params[k], v) for k, v in grads.items())]:
        for flat in R.choice(a.size, min(6, a.size), replace=False):
            at = np.unravel_index(flat, a.shape)
            assert slope(a, at) == pytest.approx(float(g[at]), rel=5e-2, abs=3e-2)


def test_embedding_gathers_and_scatters():
    e = nn.Embedding(4, 3)
    e.set_weights(weight=np.arange(12).reshape(4, 3))
    assert e.forward(np.array([[0, 1, 2], [3, 0, 1]], np.float32))[1, 0].tolist() == [9, 10, 11]
    e.backward(np.ones((2, 3, 3), np.float32))
    assert e.grads["weight"][:, 0].tolist() == [2, 2, 1, 1]
    with pytest.raises(InvalidInput):
        e.forward(np.array([[4]], np.float32))


def test_dense_regression_loss_and_training():
    d = nn.Dense(1, 1)
    d.set_weights(weight=[[1]], bias=[0])
    m = nn.Sequential().add(d).compile(nn.SGD(0.1), nn.MeanSquaredError())
    x = np.array([[0.5], [1], [1.5], [2]])
    assert m.evaluate(x, 2 * x) == pytest.approx(1.875)
    loss = m.fit(x, 2 * x, 200).loss
    assert loss[0] == pytest.approx(1.875) and loss[-1] < 1e-2
    assert len(m.fit_with_batches(x, 2 * x, 2, 3).loss) == 2


def test_categorical_gradient_of_rows_that_are_not_scaled():
    y = np.array([[1, 0, 0], [0, 1, 0]], np.float32)
    p = np.array([[0.6, 0.3, 0.3], [0.2, 0.8, 0.2]], np.float32)
    loss, h = nn.CategoricalCrossEntropy(), 1e-3
    g = loss.compute_grad(y, p)
    for at in np.ndindex(p.shape):
        q, r = p.copy(), p.copy()
        q[at] += h
        r[at] -= h
        assert (loss.compute_loss(y, q) - loss.compute_loss(y, r)) / (2 * h) == pytest.approx(float(g[at]), abs=2e-3)
    assert nn.SparseCategoricalCrossEntropy().compute_loss(np.array([[0], [1]]), p) == pytest.approx(loss.compute_loss(y, p))


@pytest.mark.parametrize("optimizer", [nn.SGD(0.05, 0.9, True), nn.Adam(0.05), nn.AdamW(0.05), nn.RMSprop(0.02), nn.AdaGrad(0.3), nn.Adam(0.05, global_clipnorm=1.0)], ids=lambda o: type(o).__name__)
def test_optimizers_learn(optimizer):
    x = R.normal(size=(64, 3)).astype(np.float32)
    y = x @ np.array([[1], [-2], [0.5]], np.float32)
    m = nn.Sequential().add(nn.Dense(3, 1, random_state=0)).compile(optimizer, nn.MeanSquaredError())
    loss = m.fit(x, y, 150).loss
    assert loss[-1] < 0.05 * loss[0]


def test_dropout_keeps_the_mean_and_predict_is_plain():
    x = np.ones((2000, 4), np.float32)
    d = nn.Dropout(0.5, random_state=0)
    assert d.forward(x).mean() == pytest.approx(1, abs=0.05) and (d.predict(x) == x).all()
    s = nn.SpatialDropout1D(0.5, random_state=0).forward(np.ones((8, 5, 3), np.float32))
    assert (s == s[:, :1]).all()
    assert nn.GaussianNoise(0.1, random_state=0).forward(x).std() == pytest.approx(0.1, rel=0.1)
    assert nn.GaussianDropout(0.2, random_state=0).forward(x).std() == pytest.approx(0.5, rel=0.1)
    with pytest.raises(InvalidParameter):
        nn.Dropout(1.5)
